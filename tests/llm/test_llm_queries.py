"""The queries and the pipeline over the supplied tables."""

import duckdb
import pytest

import corpus_pipeline
from tempora.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def test_language_on_held_out_documents(spark, tables):
    truth = dict(tables.sql("SELECT doc_id, lang FROM documents").fetchall())
    rows = [r for r in QUERIES["op10_language"](spark, FOLDER).collect() if r.held_out]
    assert len(rows) > 200 and sum(r.lang_pred == truth[r.doc_id] for r in rows) >= 0.98 * len(rows)


def test_exact_benchmark_copies_are_found(spark, tables):
    copies = set(tables.sql("SELECT doc_id, item_id FROM documents, benchmark b WHERE contains(documents.text, b.text)").fetchall())
    found = {(r.doc_id, r.item_id) for r in QUERIES["op1_decontamination"](spark, FOLDER).collect()}
    assert copies and copies <= found


def test_articles_are_extracted(spark, tables):
    pages = dict(tables.sql("SELECT page_id, html FROM pages").fetchall())
    rows = QUERIES["op6_main_text"](spark, FOLDER).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        import html
        import re

        expected = " ".join(html.unescape(re.sub(r"</?(?:p|br|h1)>", " ", article).replace("<b>", "")).split())
        assert r.text == expected


def test_pipeline(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and docs.select("doc_id").distinct().count() == counts[-1]
    assert counts[0] >= counts[1] > counts[2] > counts[3] > counts[4] > 0.8 * counts[0]
    # each stage is held against its own input: a passage that the third cut out of a document is no leak any more
    held = lambda k: {x for x, in tables.sql(f"SELECT DISTINCT doc_id FROM '{tmp_path}/{k}/*.parquet' d, benchmark b WHERE contains(d.text, b.text)").fetchall()}
    last = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    assert held(2) and not held(3) and not last & held(2)
    whole = {x for x, in tables.sql("SELECT DISTINCT doc_id FROM documents, benchmark b WHERE contains(documents.text, b.text)").fetchall()}
    shorter = {x for x, in tables.sql(f"SELECT doc_id FROM '{tmp_path}/2/*.parquet' d JOIN documents o USING (doc_id) WHERE len(d.text) < len(o.text)").fetchall()}
    assert last & whole <= shorter - held(2)
    fill = docs.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in fill) <= 4096 and len(fill) <= -(-sum(r[1] for r in fill) // 4096) + 1
