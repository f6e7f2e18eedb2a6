"""Each stage of the pipeline against a direct version on its own input."""

import pytest

import corpus_pipeline as P
from lakefind.llm.quality import fit_sample
from lakefind.llm.common import table
from lakefind.session import materialize
from llm_cases import HAVE_TABLES, SF
from test_llm_decontaminate import brute as leaks
from test_llm_jaccard import brute as groups
from test_llm_line_dedup import brute as lines
from test_llm_packing import check_places

pytestmark = pytest.mark.skipif(not HAVE_TABLES, reason="no test tables")


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, steps = docs.columns, dict(P.STAGES)
    assert list(steps) == ["quality", "line_dedup", "document_dedup", "decontamination", "packing"]

    good = materialize(steps["quality"](spark, docs, SF))
    net, given = fit_sample(docs, table(spark, SF, "labels")), rows(docs)
    scores = net.scores([t for _, t in given])
    assert good.columns == columns
    assert sorted(rows(good)) == sorted(r for r, s in zip(given, scores, strict=True) if s >= 0.3)

    lean = materialize(steps["line_dedup"](spark, good, SF))
    assert lean.columns == columns
    assert sorted(rows(lean)) == sorted((r[0], r[3]) for r in lines(rows(good)))
    assert lean.where("n_chars <> length(text)").count() == 0

    one = materialize(steps["document_dedup"](spark, lean, SF))
    named = {eval(x)[0]: eval(x)[2] for x in groups(rows(lean))}
    assert one.columns == columns
    assert sorted(rows(one)) == sorted(r for r in rows(lean) if named[r[0]] == r[0])

    clean = materialize(steps["decontamination"](spark, one, SF))
    bench = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    leaked = {d for d, _ in leaks([r for r in rows(one) if len(r[1]) < 1500], bench)}
    assert clean.columns == columns
    assert {d for d, _ in rows(one)} - {d for d, _ in rows(clean)} >= leaked
    assert sorted(r for r in rows(clean) if len(r[1]) < 1500) == sorted(
        r for r in rows(one) if len(r[1]) < 1500 and r[0] not in leaked)

    packed = steps["packing"](spark, clean, SF).collect()
    assert {r["doc_id"] for r in packed} == {d for d, _ in rows(clean)}
    check_places(packed, 2048)
