"""The corpus pipeline against plain versions of its stages, on the smallest tables."""

import corpus_pipeline
from spindrel.llm import contamination, quality

from .test_llm import ids_of, plain_components, plain_fingerprint, plain_hits, plain_lines


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in quality.verdicts(docs).where("kept").collect()}
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    gone = plain_lines(rows)
    for i, places in gone.items():
        rows[i] = "\n".join(x for p, x in enumerate(rows[i].split("\n")) if p not in places)
    rows = {i: t for i, t in rows.items() if i not in gone or t.strip(" \t\n\r\x0b\x0c")}
    prints = [(i, plain_fingerprint(t)) for i, t in rows.items()]
    least = plain_components(prints)
    rows = {i: rows[i] for i, f in prints if least[i, f] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    matcher = contamination.Matcher([(str(i), t) for i, t in items], 13)
    rows = {i: t for i, t in rows.items() if not (matcher.hits(contamination.words_of(t))[0] and plain_hits(t, items)[4])}
    enc = ids_of(spark, "")
    found = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: r.n_tokens for r in found} == {i: len(enc.encode_ordinary(t)) for i, t in rows.items()}
    assert len(found) == len(rows)


def test_stages():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
