"""Queries whose SQL covers a part of the tables only, against SQL over all of them, on tables larger than that part."""

import hashlib
import re

import pytest

from narrata import queries
from narrata.functions import text
from tests import oracle

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["snapshot_conflict_resolution", "snapshot_import", "snapshot_report"])
def test_snapshots_of_all_events(spark, name):
    whole = queries.oracle_sql()[name].replace(" AND record_id < 2000", "").replace(" AND record_id < 1000", "")
    assert "record_id <" not in whole
    oracle.check(queries.queries()[name](spark, SF), oracle.connect(SF), whole)


def test_links_of_all_orders(spark):
    whole = queries.oracle_sql()["crawl_frontier"].replace(" WHERE o_orderkey < 2000", "")
    assert "o_orderkey <" not in whole
    oracle.check(queries.queries()["crawl_frontier"](spark, SF), oracle.connect(SF), whole)


def test_every_hundredth_vector_is_a_query(spark):
    whole = queries.oracle_sql()["cosine_topk"].replace("q.vec_id < 10", "q.vec_id % 100 = 0")
    assert "vec_id <" not in whole
    oracle.check(queries.queries()["cosine_topk"](spark, SF), oracle.connect(SF), whole)


def test_cut_texts_of_all_documents(spark):
    def cut(t):
        data = t.encode()[:200]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return data[:-3].decode(errors="ignore")

    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: (None, None) if r["text"] is None else (len(x := cut(r["text"]).encode()), hashlib.sha256(x).hexdigest()) for r in texts}
    got = {r["doc_id"]: (r["whole_bytes"], r["cut_sha256"]) for r in queries.queries()["truncate_texts"](spark, SF).collect()}
    assert got == want and any(len(r["text"].encode()) > 200 for r in texts if r["text"])


def test_redacted_urls_of_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()
    secret = re.compile(rf"([?&])({'|'.join(text.SECRET_PARAMETERS)})=([^&\s]+)", re.I)
    want = {r["page_id"]: secret.sub(r"\1\2=[REDACTED]", f"{r['url']}&token=abc{r['page_id']}") for r in pages}
    assert {r["page_id"]: r["url"] for r in queries.queries()["redact_urls"](spark, SF).collect()} == want
    assert any("page=" in x for x in want.values())
