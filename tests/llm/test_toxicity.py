import random

import pytest

from folioscope.llm import toxicity
from folioscope.llm.queries import op8_toxicity


@pytest.fixture(scope="module")
def made():
    random.seed(4)
    plain = [f"{a}{b}" for a in ("bo", "ta", "mi", "ke", "lu") for b in ("ran", "dor", "sel", "vin", "pol", "gat")]
    rows, labels = [], []
    for i in range(400):
        words = random.choices(plain, k=random.randint(5, 120))
        toxic = i % 5 == 0
        if toxic:
            words.insert(random.randrange(len(words)), random.choice(["vermin", "verminous", "Dolt!", "d0lt"]))
        if i % 7 == 0 and not toxic:
            words.insert(0, "vermin control")
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_fold():
    assert toxicity.fold("You 1D10T, été\tÜ_x «аbс»") == " you idiot été ü x abc "
    assert toxicity.fold(None) == toxicity.fold("  ") == "  "


def test_terms_and_exceptions(spark, docs_of, made):
    rows, labels = made
    model = toxicity.learn(docs_of(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert any("dolt".startswith(t) for t, _ in model.terms)
    ask = [(1, "so d0lt boran"), (2, "vermin control boran"), (3, "boran dor"), (4, None), (5, ""), (1, "so d0lt boran"), (None, "DОLT"), (6, "boran " * 50_000)]
    got = [(r.doc_id, r.predicted, r.score) for r in toxicity.score(docs_of([(*a, 0.5) for a in ask], ", score double"), model).collect()]
    assert [g[:2] for g in got] == [(1, 1), (2, 0), (3, 0), (4, 0), (5, 0), (1, 1), (None, 1), (6, 0)]
    assert all(0 <= s <= 1 for _, _, s in got)


def test_exception_silences_only_its_words():
    model = toxicity.Model((("scum", 3.0),), ("pond scum",), (0.0, 1.0, 1.0, 1.0))
    starts = lambda t: [s for s, _ in model.hits(toxicity.fold(t))]
    assert starts("pond scum") == [] and starts("scum pond") == [0] and starts("pond scum, scum") == [10]


def test_few_labels(spark, docs_of):
    docs = docs_of([(1, "a b"), (2, "c")])
    none = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.predicted for r in toxicity.score(docs, none).collect()] == [0, 0]
    odd = toxicity.learn(docs, spark.createDataFrame([(1, 1), (1, 1), (None, 0), (9, None)], "doc_id long, toxic int"))
    assert toxicity.score(docs, odd).count() == 2
    assert toxicity.score(docs_of([]), none).count() == 0


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    seen = op8_toxicity(spark, folder).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in seen)
    assert len(seen) > 60 and right > 0.9 * len(seen)
