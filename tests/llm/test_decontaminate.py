import re

import pytest

from folioscope.llm import decontaminate
from folioscope.llm.queries import ORACLE, op5_decontamination
from tools.compare import connect, rows

PAT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return PAT.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    wins = []
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        wins += [(item, tuple(w[i : i + n])) for i in range(len(w) - n + 1) if n]
    out = {}
    for doc, text in docs:
        w, hit, which = words(text), set(), set()
        for item, win in wins:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    which.add(str(item))
        out[doc] = (len(w), len(hit), sorted(which))
    return out


def got(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in df.collect()}


ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short item"), (3, "solo"), (4, None), (5, " ,.;"),
    (6, "a b a b a b a b a b a b"), (7, "ein zwei drei"), (1, "one two three four five six seven eight nine ten eleven twelve"),
    (10, "É à la carte"),
]
DOCS = [
    (1, "x ONE two three-four five six seven eight nine ten eleven y"), (2, "one two three four five six seven eight nine"),
    (3, "a short  item here, SOLO"), (4, None), (5, ""), (6, "a b " * 9), (7, "ein zwei"), (8, "zwei ein zwei drei vier"),
    (9, "two three four five six seven eight nine ten eleven twelve one two"), (10, "é à la carte É À la carte É à la carte"),
    (None, "solo"), (11, "word " * 50_000),
]


@pytest.mark.parametrize("few", [0, 200_000])
def test_equals_brute_force(spark, docs_of, monkeypatch, few):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", few)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = docs_of([(*d, "k") for d in DOCS + DOCS[:2]], ", mark string")
    assert got(decontaminate.contamination(df, items)) == brute(DOCS, ITEMS)


def test_sql_twin(spark, small):
    df = op5_decontamination(spark, small)
    cur = connect(small).execute(ORACLE["op5_decontamination"])
    columns = [c[0] for c in cur.description]
    assert rows(df.columns, df.collect()) == rows(columns, cur.fetchall())


def test_odd_tables(spark, docs_of):
    items, none = spark.createDataFrame(ITEMS, "item_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs_of([]), items).count() == 0
    assert got(decontaminate.contamination(docs_of(DOCS[:3]), none)) == brute(DOCS[:3], [])
    kept = decontaminate.drop_contaminated(docs_of([(*d, 1) for d in DOCS], ", item_id int"), items)
    assert kept.columns == ["doc_id", "text", "item_id"]
    assert {r.doc_id for r in kept.collect()} == {d for d, (_, n, _) in brute(DOCS, ITEMS).items() if not n}


def test_no_python_runs(spark, small):
    plan = op5_decontamination(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan)
