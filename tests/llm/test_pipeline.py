"""The whole pipeline against plain Python over the small tables; odd rows through every stage."""

from collections import defaultdict
import re

import pytest

import corpus_pipeline as P
from conftest import SF
from keepwell.llm.queries import QUERIES
from keepwell.llm.wu_manber import words_of
from test_line_join import slow as removed_lines
from test_pivot_simhash import slow_components, slow_print
from test_vector_packing import check, LIMITS


def windows(text):
    w = words_of(text or "")
    m = min(10, len(w))
    return {tuple(w[i:i + m]) for i in range(len(w) - m + 1)} if m else set()


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs.collect()}
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out.parquet")
        made = stage(spark, docs, SF)
        if name != "packing":
            assert made.columns == docs.columns
        made.write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs.collect()
    return out


def texts(rows):
    return {r.doc_id: r.text for r in rows}


def test_quality(spark, stages):
    scored = QUERIES["op7_rule_quality"](spark, SF)
    assert set(texts(stages["quality"])) == {r.doc_id for r in scored.where("predicted = 1").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = set(texts(stages["quality"]))
    good = [i for i, q in labels.items() if q and i in texts(stages["documents"])]
    assert sum(i in kept for i in good) / len(good) > 0.97
    bad = [i for i, q in labels.items() if not q and i in texts(stages["documents"])]
    assert sum(i in kept for i in bad) / len(bad) < 0.2


def test_lines(stages):
    before = list(texts(stages["quality"]).items())
    gone = removed_lines(before)
    assert gone and texts(stages["lines"]) == {
        i: t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in before}
    assert all(r.n_chars == len(r.text or "") for r in stages["lines"])


def test_near_copies(stages):
    before = texts(stages["lines"])
    component = slow_components([(i, slow_print(t)) for i, t in before.items()])
    assert texts(stages["near_copies"]) == {i: t for i, t in before.items() if component[i] == i}


def test_benchmark(spark, stages):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    by_size = defaultdict(set)
    for w in (w for t in items for w in windows(t)):
        by_size[len(w)].add(w)

    def hit(text):
        w = words_of(text or "")
        return any(tuple(w[i:i + m]) in known for m, known in by_size.items() for i in range(len(w) - m + 1))

    assert texts(stages["benchmark"]) == {i: t for i, t in texts(stages["near_copies"]).items() if not hit(t)}


def test_packing(stages):
    padding, _ = check(stages["packing"], texts(stages["benchmark"]), LIMITS)
    assert padding == 0


def test_run_is_the_stages(spark, stages):
    key = lambda rows: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)
    pieces = defaultdict(int)
    for r in P.run(spark, SF).collect():
        pieces[r.doc_id] += r.length
    other = defaultdict(int)
    for r in stages["packing"]:
        other[r.doc_id] += r.length
    assert pieces == other


def test_odd_rows_through_every_stage(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, items string, fp long"
    rows = [(1, None), (2, ""), (3, "word"), (3, "word"), (None, "fine words of a text\nand more"), (5, " \n\n"), (6, "long " * 100_000)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 0.5, "x", 1) for i, t in rows], schema)
    for start in (docs, docs.limit(0)):
        now = start
        for name, stage in P.STAGES:
            out = stage(spark, now, SF)
            assert name == "packing" or out.columns == docs.columns
            out.count()
            now = out if name != "packing" else now


def test_filters_leave_columns_of_any_name_alone(spark):
    from keepwell.llm.base import without

    names = ["filter_at", "filter_word", "filter_mask", "filter_hit", "Filter_Word2"]
    rows = spark.createDataFrame([(i, *[f"{n}-{i}" for n in names]) for i in range(20)], ["doc_id", *names])
    left = without(rows, "doc_id", rows.where("doc_id < 15").select("doc_id"))
    assert left.columns == rows.columns
    assert sorted(map(tuple, left.collect())) == sorted(map(tuple, rows.where("doc_id >= 15").collect()))
