"""Command line: ``spark-submit -m gleaner`` or ``python -m gleaner <job> ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import language, probe, retrieval
from .operators.links import link_stats
from .plans import clean_pages, crawl_picks, rerank_eval, train_probe
from .runtime import clear_scratch
from .sources import blocklist, lines, responses, tables, warc_files
from .streaming import ingest


def fit_language(spark, a):
    language.fit_language_model(spark.read.parquet(a.labelled).select("text", "lang")).save(a.model)


def clean_warcs(spark, a):
    paths, missing = lines.listed_files(spark, a.list, a.warcs, a.first, a.last) if a.list else (a.warcs, [])
    if missing:
        print(f"listed files that are not there: {len(missing)}", *missing[:10], sep="\n  ")
    if not paths:
        raise SystemExit("no listed file is there")
    curated = tables.read_curated(spark, a.curated, "url") if a.curated else None
    pages = clean_pages.clean_warc(
        warc_files.read_files(spark, paths),
        blocklist.read_blocklist(spark, a.blocklist),
        language.load_language_model(spark, a.model),
        curated_urls=curated,
        min_pages=a.min_pages,
    )
    if a.csv:
        tables.write_pages_csv(pages, a.out)
    else:
        named = pages.withColumn("warc_file", F.substring_index(F.substring_index("warc_file", "/", -1), ".", 1))
        tables.write_pages(named, a.out, by="warc_file")


def ingest_warcs(spark, a):
    listed = blocklist.read_blocklist(spark, a.blocklist)
    pages = ingest.warc_stream(spark, a.warcs)
    if a.model:
        ingest.ingest_clean(pages, listed, language.load_language_model(spark, a.model), a.out, a.checkpoint)
    else:
        ingest.ingest(pages, listed, a.out, a.checkpoint)


def extract_links(spark, a):
    found = crawl_picks.links_from_responses(responses.read_responses(spark, a.responses))
    found.write.mode("overwrite").text(a.out)
    print("distinct external links:", link_stats(spark.read.text(a.out)).first()["n_links"])


def pick_urls(spark, a):
    picks = crawl_picks.pick_crawl_urls(spark.read.text(a.index), spark.read.text(a.links), a.seed)
    tables.write_picks(picks, a.out, "append" if a.append else "overwrite")


def train(spark, a):
    def texts(path, label):
        if path.endswith(".parquet"):
            rows = spark.read.parquet(path).select("text")
        else:
            rows = lines.read_labelled_folder(spark, path, label).select("text")
        # A line has no key of its own: equal lines become one row with a count.
        counted = rows.groupBy("text").agg(F.count("*").alias("copies"))
        return counted.withColumn("key", F.sha2(F.concat(F.lit(f"{label} "), "text"), 256))

    sample = train_probe.labelled_sample(texts(a.good, 1), texts(a.bad, 0), "key", a.rows, a.seed, "copies")
    trained = train_probe.train_quality_probe(sample, a.features)
    trained.scores.show()
    trained.report.show()
    probe.save_model(spark, trained.model, a.model)


def rerank_runs(spark, a):
    """Queries (query_id, embedding, task), corpus (doc_id, embedding, one
    ``q_*`` quality column per model) and judgements (query_id, doc_id, rel)."""
    queries, corpus = spark.read.parquet(a.queries), spark.read.parquet(a.corpus)
    names = [c for c in corpus.columns if c.startswith("q_")]
    run = rerank_eval.retrieve(queries, corpus.select("doc_id", "embedding"), a.top)
    run = run.join(queries.select("query_id", "task"), "query_id").join(corpus.select("doc_id", *names), "doc_id")
    judged = retrieval.judge(run, spark.read.parquet(a.relevant))
    qualities = {c[2:]: F.col(c) for c in names}
    rerank_eval.evaluate(judged, qualities).show(200)
    if a.out:
        tables.write_predictions(retrieval.sweep(judged, qualities, rerank_eval.QUALITY_WEIGHTS), a.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gleaner")
    jobs = top.add_subparsers(required=True)

    def job(fn, *options):
        p = jobs.add_parser(fn.__name__.replace("_", "-"))
        p.set_defaults(job=fn)
        for name, settings in options:
            p.add_argument(f"--{name}", **settings)

    need, seed = {"required": True}, ("seed", {"type": int, "default": 42})
    job(fit_language, ("labelled", need), ("model", need))
    job(
        clean_warcs, ("warcs", need), ("blocklist", need), ("model", need), ("out", need), ("curated", {}),
        ("min-pages", {"type": int}), ("csv", {"action": "store_true"}), ("list", {}),
        ("first", {"type": int, "default": 0}), ("last", {"type": int}),
    )
    job(ingest_warcs, ("warcs", need), ("blocklist", need), ("out", need), ("checkpoint", need), ("model", {}))
    job(extract_links, ("responses", need), ("out", need))
    job(pick_urls, ("index", need), ("links", need), ("out", need), ("append", {"action": "store_true"}), seed)
    job(
        train, ("good", need), ("bad", need), ("model", need), ("rows", {"type": int, "default": train_probe.CURATED_AGAINST_CRAWL}),
        ("features", {"type": int, "default": 4096}), seed,
    )
    job(rerank_runs, ("queries", need), ("corpus", need), ("relevant", need), ("top", {"type": int, "default": 50}), ("out", {}))
    return top


def main(argv=None) -> None:
    arguments = parser().parse_args(argv)
    spark = SparkSession.builder.appName("gleaner").getOrCreate()
    try:
        arguments.job(spark, arguments)
    finally:
        clear_scratch(spark)


if __name__ == "__main__":
    main()
