import datetime as dt
import random

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions.vocabulary import (
    DATASETS,
    METRICS,
    claim_sentences,
    cue_names,
    vocabulary_hits,
)
from folioscope.operators.extraction import match_names


def values(spark, expression, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, text STRING")
    return [r[1] for r in df.select("i", expression(F.col("text")).alias("v")).orderBy("i").collect()]


def test_clean_text_and_titles(spark):
    assert values(spark, T.clean_text, ["  a \n b c ", None, "\xa0"]) == ["a b c", "", ""]
    assert values(spark, T.normalize_title, ["Graph Attention Networks!", "Graph   Attention\nNetworks", "GCNs: é"]) == [
        "graph attention networks", "graph attention networks", "gcns"]


def test_tokenize(spark):
    got = values(spark, T.tokenize, ["Graph Neural Networks", "the graph is a network of the nodes",
                                     "graphs, networks; and more!", "", "élan café x 12"])
    assert got == [["graph", "neural", "networks"], ["graph", "network", "nodes"],
                   ["graphs", "networks", "more"], [], ["lan", "caf", "12"]]


def test_strip_lines_sentences(spark):
    assert values(spark, T.strip, ["\t\x1c a b　\n"]) == ["a b"]
    cases = ["", "\n", "a\n", "a\r\nb\x0cc d", "a\n\nb\n"]
    assert values(spark, T.split_lines, cases) == [c.splitlines() for c in cases]


def test_dates_and_ids(spark):
    got = values(spark, T.parse_utc, ["2017-02-22T18:59:35Z", "2017-02-22", "garbage", None, "2017-02-30T00:00:00Z"])
    assert got == [dt.datetime(2017, 2, 22, 18, 59, 35), None, None, None, None]
    assert values(spark, T.arxiv_id, ["http://arxiv.org/abs/1609.02907v4", "http://arxiv.org/abs/x/1v2/", "plain"]) == [
        "1609.02907v4", "x/1v2", "plain"]
    assert values(spark, T.arxiv_base_id, ["1609.02907v4", "1609.02907"]) == ["1609.02907", "1609.02907"]


def test_figures_and_years(spark):
    assert values(spark, T.first_percentage, ["gets 84.2 % and 3%", "1234%", "84.2 points", None]) == [84.2, 234.0, None, None]
    assert values(spark, T.first_year, ["in 2017 and 2018", "x2017", "1850", "(1999)"]) == [2017, None, None, 1999]


def test_vocabulary(spark):
    find = lambda c: vocabulary_hits(c, DATASETS)
    assert values(spark, find, ["We test on cora and CITESEER and pubmed.", "optimization theory", "shipping logistics",
                                "WikiText-2 and CIFAR-100", "ogb-arxiv"]) == [
        ["Citeseer", "Cora", "PubMed"], [], [], ["CIFAR-100", "WikiText", "WikiText-2"], ["OGB", "OGB-Arxiv"]]
    metrics = values(spark, lambda c: vocabulary_hits(c, METRICS), ["accuracy, F1 score, AUC and hits@10", "F1-score", ""])
    assert metrics == [["AUC", "F1", "F1 score", "accuracy", "hits@10"], ["F1", "F1-score"], []]


def test_vocabulary_against_single_patterns(spark):
    import itertools
    import re

    words = ["a", "a-b", "a-b-c", "ab", "b", "B c", "b-c"]
    texts = ["".join(p) for p in itertools.product(["a", "-", "b", " ", "C"], repeat=5)]
    got = values(spark, lambda c: vocabulary_hits(c, words), texts)
    want = [sorted(w for w in words if re.search(rf"\b{re.escape(w)}\b", t, re.I)) for t in texts]
    assert got == want


def test_cues_and_claims(spark):
    assert values(spark, cue_names, [
        "In this work, we propose GraphMix for nodes.",
        "We introduce Contrastive Alignment as a loss. We present the Big\nNet. we PROPOSE a Tiny Net",
        "no proposal", "we propose a new thing"]) == [
        ["GraphMix"], ["Tiny Net", "Contrastive Alignment", "Big\nNet"], [], []]
    assert values(spark, claim_sentences, [
        "Our model is fast. It achieves 84.2% accuracy on Cora.",
        "This is a 2.1 points improvement.", "5 percent! 3 pp? 7 pointless", "simple"]) == [
        ["It achieves 84.2% accuracy on Cora."], ["This is a 2.1 points improvement."], ["5 percent!", "3 pp?"], []]


def test_display(spark):
    assert values(spark, lambda c: T.prefix(c, 3), ["abcd", "abc"]) == ["abc…", "abc"]
    assert values(spark, lambda c: T.join_first(F.split(c, " "), 2), ["a b c", "a b"]) == ["a, b, et al.", "a, b"]
    assert values(spark, T.capitalize_first, ["proposes M1", ""]) == ["Proposes M1", ""]


def found(spark, texts, names):
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, text STRING")
    table = spark.createDataFrame([(n,) for n in names], "name STRING")
    return sorted((r.i, r.name) for r in match_names(df, "text", table).collect())


def test_names_of_a_table_equal_names_of_a_list(spark):
    rng = random.Random(5)
    bits = ["CIFAR", "cifar", "10", "-", " ", "@", "hits", "C", "++", "é", "F1", "score", ".", "_", "Straße", "  ", "\n"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(14))) for _ in range(400)]
    texts += [None, "", "  ", "Trained on ImageNet and CIFAR-10, hits@10.", "C++x and C++", "x@home @home", "word " * 20000 + "MNIST"]
    names = {"".join(rng.choices(bits, k=rng.randrange(1, 5))) for _ in range(150)}
    names = [n for n in names if any(c.isalnum() or c == "_" for c in n)]
    names += ["CIFAR-10", "cifar-10", "hits@10", "C++", "@home", *DATASETS, *METRICS]
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, text STRING")
    listed = df.select("i", F.explode(vocabulary_hits(F.col("text"), names)).alias("name")).collect()
    assert found(spark, texts, names + names[:9]) == sorted((r.i, r.name) for r in listed)


def test_names_of_a_table_odd_input(spark):
    assert found(spark, ["a b", None], []) == found(spark, [], ["a"]) == []
    assert found(spark, ["a ++ b"], [None, "", " ", "++"]) == []
    assert found(spark, ["K \u212a", "s \u017f", "\u0130 x"], ["k", "S", "I"]) == [(0, "k"), (1, "S"), (2, "I")]
    clash = spark.createDataFrame([(1, "a", "u", "v"), (1, "a", "u", "v")], "_shapes INT, text STRING, name STRING, `_form` STRING")
    table = spark.createDataFrame([("A",)], "name STRING")
    got = match_names(clash, "text", table)
    assert got.columns == ["_shapes", "_form", "name"] and [tuple(r) for r in got.collect()] == [(1, "v", "A")] * 2
