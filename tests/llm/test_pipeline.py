"""The pipeline stage by stage beside plain versions, and the registered queries beside their SQL."""

from __future__ import annotations

import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from edictal.llm.queries import QUERIES
from edictal.llm.sql import SQL
from tests.llm.test_dups import LOWER, links, shingles
from tests.llm.test_models import graded, make

PATH = "/root/testdata/sf0.001"
LABELS = "doc_id long, quality int, toxic int"
# Names that the operators use inside, and one that needs quotes.
MORE = ("row", "id", "doc", "score", "predicted", "selected", "kept", "filter_hash", "__text", "a.b")


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    from edictal.llm.queries import prepared

    prepared(spark)
    folder = tmp_path_factory.mktemp("tables")
    texts, marks = make(400, 21)
    poor, grades = graded(400, 22)
    rows = [(i, t, int(m), 1) for i, (t, m) in enumerate(zip(texts, marks, strict=True))]
    rows += [(400 + i, t, 0, int(g >= 2)) for i, (t, g) in enumerate(zip(poor, grades, strict=True)) if g in (0, 3)]
    spark.createDataFrame([(i, q, t) for i, _, t, q in rows], LABELS).write.parquet(str(folder / "labels.parquet"))
    docs = [(i, t) for i, t, _, _ in rows]
    docs += [(2000 + i, t.upper() if i % 2 else t) for i, t in docs[:60]] + [(3000 + i, t.replace(t.split(" ")[2], "other", 1)) for i, t in docs[60:120]]
    docs += [(None, None), (None, ""), (1, docs[1][1]), (5000, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    frame.withColumns({c: F.lit(c) for c in MORE}).write.parquet(str(folder / "documents.parquet"))
    return folder, {i: (t, q) for i, _, t, q in rows}


def stages(spark, folder):
    """What every stage was given and returned."""
    docs, out = spark.read.parquet(str(folder / "documents.parquet")), []
    for k, (name, apply) in enumerate(P.STAGES):
        target = str(folder / f"stage-{k}")
        apply(spark, docs, str(folder)).write.mode("overwrite").parquet(target)
        after = spark.read.parquet(target)
        out.append((name, docs, after))
        docs = after
    return out


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=repr)


def test_stages(spark, case):
    folder, labels = case
    done = stages(spark, folder)
    assert [n for n, _, _ in done] == ["toxicity", "quality", "exact_dedup", "near_dedup", "packing"]
    for _, before, after in done[:-1]:
        assert after.columns == before.columns and after.filter("`a.b` <> 'a.b' or row <> 'row'").isEmpty()
    for (_, before, after), bad, good in ((done[0], 1, lambda t, q: t == 0), (done[1], 0, lambda t, q: t == 0 and q == 1)):
        given, left = pairs(before), pairs(after)
        assert set(left) <= set(given)
        wrong = [i for i, _ in given if i in labels and labels[i][bad == 0] == bad]
        assert sum(i in {x for x, _ in left} for i in wrong) <= 0.1 * len(wrong)
        clean = [i for i, _ in given if i in labels and good(*labels[i])]
        assert sum(i not in {x for x, _ in left} for i in clean) <= 0.02 * len(clean)
    given, left = pairs(done[2][1]), pairs(done[2][2])
    best: dict[str, list] = {}
    for i, t in given:
        best.setdefault((t or "").translate(LOWER), []).append((i is not None, i or 0))
    assert sorted(((t or "").translate(LOWER), (i is not None, i or 0)) for i, t in left) == sorted((t, max(ids)) for t, ids in best.items())
    given, left = pairs(done[3][1]), pairs(done[3][2])
    groups = {c for (i, n, c) in links(given, P.NEAR_PERCENT) if n}
    assert sorted(repr(i) for i, t in left if shingles(t)) == sorted(groups)
    assert sum(not shingles(t) for _, t in left) == sum(not shingles(t) for _, t in given)
    packed = done[4][2].collect()
    assert sorted({repr(r.doc_id) for r in packed}) == sorted({repr(i) for i, _ in left})
    assert sum(r.length for r in packed if r.offset == 0) > 0 and max(r.offset + r.length for r in packed) <= 2048


def test_stages_of_nothing(spark, tmp_path):
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).collect() == []


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14)) and set(SQL) <= set(QUERIES)
    assert 4 <= len(P.STAGES) <= 5


@pytest.mark.skipif(not Path(PATH).is_dir(), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{PATH}/{t}.parquet'")
    got = QUERIES[name](spark, PATH)
    want = db.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, want.fetchall()))
