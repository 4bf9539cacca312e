"""One query per operator, over whole tables; names match ``duck_sql``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import html, probability, text, urls
from gleaner.operators import (
    boilerplate, ids, language, links, membership, perplexity, pooling, probe, retrieval, sampling, scores,
)
from gleaner.plans import clean_pages as cleaning
from gleaner.plans import crawl_picks, rerank_eval, train_probe
from gleaner.runtime import materialise, scratch_path
from gleaner.sources import blocklist as bl
from gleaner.sources import crawl_index, lines, responses, tables, warc
from gleaner.sources import warc_files as warc_files_source
from gleaner.streaming import ingest

from . import fixtures as fx

REGISTRY = {}


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


def r6(column, digits: int = 6):
    return F.round(column, digits)


# --- scans, sources, sinks -------------------------------------------------


@query
def path_list(spark, d):
    found = lines.path_list(fx.path_lines(spark, d))
    loose = lines.path_list(fx.path_lines(spark, d), match="contains")
    return found.withColumn("match", F.lit("suffix")).unionByName(loose.withColumn("match", F.lit("contains")))


@query
def warc_records(spark, d):
    parsed = warc.parse_records(fx.warc_records(spark, d))
    return parsed.select("rec_type", "url", "content_length", "payload", "reject")


@query
def warc_files(spark, d):
    """The same records, written as files and framed by their lengths."""
    folder = scratch_path(spark, "warc-files")
    materialise(fx.warc_files(spark, d, folder), "warc-index")
    return warc_files_source.read_files(spark, folder).select("rec_type", "url", "content_length", "payload", "reject")


@query
def picked_pages(spark, d):
    """Pages of the English picks, read from the places the index names."""
    folder = scratch_path(spark, "warc-files")
    index = materialise(fx.warc_files(spark, d, folder), "warc-index")
    picks = index.where(F.col("url").contains("/en/"))
    return warc.responses(warc_files_source.read_records(picks, folder)).select("url", "html")


@query
def http_body(spark, d):
    return warc.responses(warc.parse_records(fx.warc_records(spark, d))).select("url", "html")


@query
def cdx_parse(spark, d):
    return crawl_index.parse_index(fx.index_lines(spark, d))


@query
def cdx_english(spark, d):
    return crawl_index.english_entries(crawl_index.parse_index(fx.index_lines(spark, d)))


@query
def article_list(spark, d):
    return lines.article_list(fx.article_lines(spark, d))


@query
def blocklist_scan(spark, d):
    return fx.blocklist(spark, d)


@query
def labelled_text(spark, d):
    """One row per line of the labelled documents, as a folder scan gives."""
    docs = fx.labelled_documents(spark, d)
    per_line = docs.select("quality", F.explode(F.split("text", "\n")).alias("value"))
    good = lines.labelled_lines(per_line.where("quality = 1"), 1)
    bad = lines.labelled_lines(per_line.where("quality = 0"), 0)
    return sampling.labelled_union([good, bad])


@query
def page_csv_scan(spark, d):
    path = scratch_path(spark, "pages-csv")
    tables.write_pages_csv(fx.page_texts(spark, d), path)
    return tables.read_pages_csv(spark, path)


@query
def page_sink(spark, d):
    path = scratch_path(spark, "pages")
    pages = fx.page_texts(spark, d).withColumn("warc_file", F.regexp_extract("url", "^https?://[^/]*/([a-z]+)/", 1))
    tables.write_pages(pages.drop("page_id"), path, by="warc_file")
    return spark.read.schema("url STRING, text STRING, warc_file STRING").parquet(path)


@query
def merge_pages(spark, d):
    path = scratch_path(spark, "parts")
    texts = fx.page_texts(spark, d).select("url", "text")
    tables.write_pages_csv(texts.where(F.col("url").startswith("https:")), f"{path}/a.csv")
    tables.write_pages_csv(texts.where(F.col("url").startswith("http:")), f"{path}/b.csv")
    parts = [tables.read_pages_csv(spark, f"{path}/{part}.csv") for part in "ab"]
    tables.write_pages(tables.merge_pages(parts), f"{path}/merged")
    return spark.read.schema(tables.PAGE_SCHEMA).parquet(f"{path}/merged")


@query
def labelled_sink(spark, d):
    path = scratch_path(spark, "labelled")
    docs = fx.labelled_documents(spark, d)
    named = docs.select(F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), "text", F.col("quality").alias("label"))
    tables.write_labelled(named, path)
    return tables.read_labelled(spark, path)


@query
def curated_scan(spark, d):
    return tables.read_curated(spark, f"{d}/pages.parquet", "url")


@query
def incremental_pages(spark, d):
    """The stream runs twice with one checkpoint; the second run adds nothing."""
    out, checkpoint = scratch_path(spark, "ingested"), scratch_path(spark, "ingest-checkpoint")
    blocked = materialise(fx.blocklist(spark, d), "blocklist")
    for _ in range(2):
        ingest.ingest(ingest.page_stream(spark, f"{d}/pages.parquet*"), blocked, out, checkpoint)
    return spark.read.schema("page_id BIGINT, url STRING, text STRING").parquet(out)


@query
def incremental_clean(spark, d):
    """As above with the language filter, cleaned batch by batch."""
    out, checkpoint = scratch_path(spark, "cleaned"), scratch_path(spark, "clean-checkpoint")
    blocked = materialise(fx.blocklist(spark, d), "blocklist")
    model = language_model(spark, d)
    for _ in range(2):
        ingest.ingest_clean(ingest.page_stream(spark, f"{d}/pages.parquet*"), blocked, model, out, checkpoint)
    return spark.read.schema("page_id BIGINT, url STRING, text STRING").parquet(f"{out}/batch=*")


# --- expressions and filters -----------------------------------------------


@query
def extract_text(spark, d):
    return fx.page_texts(spark, d).select("page_id", "text")


@query
def main_block(spark, d):
    return fx.pages(spark, d, "page_id", "html").select("page_id", html.main_block(F.col("html")).alias("text"))


@query
def article_text(spark, d):
    return fx.pages(spark, d, "page_id", "html").select("page_id", html.article_text(F.col("html")).alias("text"))


@query
def host_boilerplate(spark, d):
    return boilerplate.host_boilerplate(materialise(fx.page_texts(spark, d), "texts"))


@query
def clean_blocks(spark, d):
    return boilerplate.drop_boilerplate(materialise(fx.page_texts(spark, d), "texts")).select("page_id", "text")


def language_model(spark, d) -> language.LanguageModel:
    return language.fit_language_model(fx.documents(spark, d, "text", "lang"))


@query
def language_scores(spark, d):
    found = language.language_scores(fx.documents(spark, d, "doc_id", "text"), language_model(spark, d))
    return found.select("doc_id", "lang", r6("p").alias("p"))


@query
def english_filter(spark, d):
    docs = fx.documents(spark, d, "doc_id", "text")
    return language.keep_language(docs, language_model(spark, d)).select("doc_id", "text")


@query
def english_top1(spark, d):
    docs = fx.documents(spark, d, "doc_id", "text")
    return language.keep_language(docs, language_model(spark, d), above=None).select("doc_id")


@query
def url_authority(spark, d):
    url = F.col("url")
    variants = F.array(
        url,
        F.replace(url, F.lit("://"), F.lit("://Me:pw@")),
        F.replace(url, F.lit(".com/"), F.lit(".COM:8080/")),
        F.regexp_replace(url, "^https?:", ""),
        F.regexp_replace(url, "^https?://", ""),
    )
    shown = fx.pages(spark, d, "url").select(F.explode(variants).alias("url"))
    return shown.select("url", urls.authority(F.col("url")).alias("authority"))


@query
def safe_name(spark, d):
    titled = fx.pages(spark, d, "page_id", "url", "html").select(
        "page_id", F.concat("url", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)).alias("url")
    )
    return titled.select("page_id", urls.safe_file_name(F.col("url")).alias("file_name"))


@query
def url_title(spark, d):
    hrefs = fx.article_lines(spark, d).select(F.substring_index("value", " - ", 1).alias("href"))
    title = urls.title_from_url(F.col("href"))
    return hrefs.select("href", title.alias("title"), urls.url_from_title(title, "https://en.wikipedia.org/wiki/").alias("url"))


@query
def explode_links(spark, d):
    saved = fx.responses(spark, d)
    inner = responses.internal_links(saved).withColumn("kind", F.lit("internal"))
    return inner.unionByName(responses.external_links(saved).withColumn("kind", F.lit("external")))


@query
def harvest_anchors(spark, d):
    found = fx.pages(spark, d, "page_id", "html")
    return found.select("page_id", F.inline(html.anchors(F.col("html"), fx.NAV)))


@query
def warc_stem(spark, d):
    path = F.col("path")
    return lines.path_list(fx.path_lines(spark, d), "contains").select(
        "path", urls.tail(path).alias("tail"), urls.last_segment(path).alias("segment"), urls.file_stem(path).alias("stem")
    )


@query
def reject_counts(spark, d):
    index = membership.reject_counts(crawl_index.parse_index(fx.index_lines(spark, d)))
    records = membership.reject_counts(warc.parse_records(fx.warc_records(spark, d)))
    return index.withColumn("source", F.lit("index")).unionByName(records.withColumn("source", F.lit("warc")))


@query
def sigmoid_score(spark, d):
    return fx.classifier_output(spark, d).select("vec_id", r6(probability.sigmoid(F.col("logit"))).alias("score"))


@query
def seq_ids(spark, d):
    """Numbers of the kept rows without gaps and, from the numbering of all
    rows, with gaps."""
    rows = fx.pages(spark, d, "url")
    kept = F.col("url").contains("/en/")
    dense = ids.sequential_ids(rows, "url", "seq", kept)
    gaps = ids.sequential_ids(rows, "url", "seq").where(kept)
    return dense.withColumn("mode", F.lit("dense")).unionByName(gaps.withColumn("mode", F.lit("gaps")))


# --- joins -----------------------------------------------------------------


@query
def novel_urls(spark, d):
    entries = crawl_index.parse_index(fx.index_lines(spark, d)).where("reject IS NULL").select("url", "filename")
    return membership.novel_urls(entries, links.distinct_links(fx.link_lines(spark, d)))


@query
def not_in_curated(spark, d):
    return membership.anti_join(fx.pages(spark, d, "page_id", "url"), fx.curated_urls(spark, d), "url").select("page_id", "url")


@query
def blocklist_filter(spark, d):
    listed = fx.blocklist(spark, d)
    kept = membership.drop_blocked(fx.pages(spark, d, "page_id", "url"), bl.domains(listed), bl.blocked_urls(listed))
    return kept.select("page_id", "url")


# --- aggregations ----------------------------------------------------------


@query
def link_stats(spark, d):
    return links.link_stats(fx.link_lines(spark, d))


def predictions(spark, d) -> DataFrame:
    return probe.decide(fx.classifier_output(spark, d)).select("label", "pred")


@query
def confusion_matrix(spark, d):
    return scores.confusion_matrix(predictions(spark, d))


@query
def classification_report(spark, d):
    report = scores.classification_report(predictions(spark, d))
    return report.select("name", *[r6(m).alias(m) for m in ("precision", "recall", "f1")], "support")


@query
def macro_metrics(spark, d):
    found = scores.macro_metrics(predictions(spark, d))
    return found.select(*[r6(m).alias(m) for m in found.columns])


@query
def mean_pool(spark, d):
    pooled = pooling.mean_pool(fx.embeddings(spark, d), "label", "embedding")
    return pooled.select("label", "n", F.posexplode("embedding").alias("pos", "v")).withColumn("v", r6("v"))


@query
def funnel_counts(spark, d):
    """Pages left after each step of page cleaning, in one aggregation."""
    listed = fx.blocklist(spark, d)
    rows = fx.page_texts(spark, d).withColumn("domain", urls.authority(F.col("url")))
    rows = membership.mark_member(rows, bl.domains(listed), "domain", "bad_domain")
    rows = membership.mark_member(rows, bl.blocked_urls(listed), "url", "bad_url")
    top = language.top_language(rows, language_model(spark, d), "page_id")
    rows = rows.join(top, "page_id", "left")
    return membership.stage_counts(
        rows,
        {
            "all": F.lit(True),
            "allowed": ~F.col("bad_domain") & ~F.col("bad_url"),
            "with text": text.has_text(F.col("text")),
            "english": (F.col("lang") == "en") & (F.col("p") > 0.6),
        },
    )


# --- limits, samples, order ------------------------------------------------


@query
def crawl_pick(spark, d):
    path = scratch_path(spark, "picks")
    picks = crawl_picks.pick_crawl_urls(fx.index_lines(spark, d), fx.link_lines(spark, d))
    tables.write_picks(picks, path)
    return spark.read.schema("url STRING, filename STRING").parquet(path)


@query
def crawl_curation(spark, d):
    """From saved API responses to crawl picks."""
    some = F.col("url").contains("?page=") | F.col("url").contains("#top")
    found = materialise(crawl_picks.links_from_responses(fx.responses(spark, d, some)), "links")
    return crawl_picks.pick_crawl_urls(fx.index_lines(spark, d), found)


@query
def head_n(spark, d):
    return sampling.head_n(fx.page_texts(spark, d).select("url", "text"), 20, "url")


@query
def balanced_negatives(spark, d):
    docs = fx.documents(spark, d, "doc_id", "text").select("doc_id", F.substring_index("text", "\n", 1).alias("title"))
    labels = fx.table(spark, d, "labels", "doc_id", "quality")
    good = docs.join(labels.where("quality = 1"), "doc_id", "left_semi")
    candidates = membership.anti_join(docs, labels, "doc_id")
    return sampling.balanced_negatives(candidates, good).select("doc_id", "title")


@query
def class_sample(spark, d):
    docs = fx.labelled_documents(spark, d)
    return sampling.exact_sample(docs, 50, "doc_id", by="quality").select("doc_id", "quality", "text")


@query
def take_sample(spark, d):
    return sampling.exact_sample(fx.documents(spark, d, "doc_id", "text"), 100, "doc_id").select("doc_id", "text")


@query
def labelled_union(spark, d):
    docs = fx.labelled_documents(spark, d)
    parts = [docs.where(F.col("quality") == q).select("doc_id", "text", F.col("quality").alias("label")) for q in (1, 0)]
    return sampling.labelled_union(parts)


@query
def seeded_shuffle(spark, d):
    return sampling.shuffled_position(fx.documents(spark, d, "doc_id"), "doc_id")


@query
def train_test_split(spark, d):
    return sampling.train_test_split(fx.documents(spark, d, "doc_id"), "doc_id")


@query
def exact_split(spark, d):
    docs = fx.table(spark, d, "labels", "doc_id", "quality")
    n_test = int(docs.count() * 0.2)
    return sampling.exact_train_test_split(docs, "doc_id", n_test).select("doc_id", "split")


# --- arrays and probabilities ----------------------------------------------


def class_probabilities(spark, d) -> DataFrame:
    return fx.class_logits(spark, d).select("vec_id", probability.softmax(F.col("logits")).alias("p"))


@query
def softmax(spark, d):
    return class_probabilities(spark, d).select("vec_id", F.posexplode("p").alias("class", "p")).withColumn("p", r6("p"))


@query
def argmax_label(spark, d):
    index = probability.argmax(F.col("p"))
    names = {i: f"c{i}" for i in range(64)}
    return class_probabilities(spark, d).select("vec_id", index.alias("class"), probability.label_of(index, names).alias("label"))


@query
def topk_confidence(spark, d):
    return class_probabilities(spark, d).select("vec_id", r6(probability.topk_mean(F.col("p"), 3)).alias("confidence"))


@query
def threshold_confidence(spark, d):
    found = probability.max_or_default(F.col("p"), 0.022, 0.005)
    return class_probabilities(spark, d).select("vec_id", r6(found).alias("confidence"))


@query
def entropy_confidence(spark, d):
    return class_probabilities(spark, d).select("vec_id", r6(probability.entropy_confidence(F.col("p"))).alias("confidence"))


def _rounded_perplexity(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_tokens", r6("nll").alias("nll"), r6("perplexity", 3).alias("perplexity"), r6("quality").alias("quality")
    )


@query
def unigram_perplexity(spark, d):
    docs = fx.documents(spark, d, "doc_id", "text")
    return _rounded_perplexity(perplexity.perplexity(docs, perplexity.fit_unigrams(docs)))


@query
def bigram_perplexity(spark, d):
    docs = fx.documents(spark, d, "doc_id", "text")
    return _rounded_perplexity(perplexity.perplexity(docs, perplexity.fit_bigrams(docs)))


# --- machine learning ------------------------------------------------------


def _texts_with_label(spark, d):
    return fx.labelled_documents(spark, d).select("doc_id", "text", F.col("quality").cast("double").alias("label"))


@query
def text_features(spark, d):
    docs = _texts_with_label(spark, d)
    made = probe.text_features().fit(docs).transform(docs)
    values = F.col("features.x")
    return made.select(
        "doc_id", F.size(F.filter(values, lambda x: x > 0)).alias("n_features"),
        r6(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), 3).alias("weight"),
    )


def _vectors_with_label(spark, d):
    rows = probe.vector_features(fx.embeddings(spark, d))
    return rows.select("vec_id", "features", (F.col("label") < 5).cast("double").alias("label"))


@query
def linear_probe(spark, d):
    rows = _vectors_with_label(spark, d)
    return probe.with_logit(rows, probe.linear_probe(rows)).select("vec_id", r6("logit", 4).alias("logit"))


@query
def probe_gradient(spark, d):
    """At the least-squares fit the residuals are orthogonal to every feature
    and to the constant: the sums below vanish."""
    rows = _vectors_with_label(spark, d)
    fitted = probe.with_logit(rows, probe.linear_probe(rows))
    terms = fitted.select(F.col("label"), F.col("logit"), F.posexplode(F.array_append("features", F.lit(1.0))).alias("feature", "x"))
    gap = F.abs(F.sum((F.col("label") - F.col("logit")) * F.col("x")))
    return terms.groupBy("feature").agg(r6(gap).alias("gradient"), F.count("*").alias("n"))


@query
def grid_gradient(spark, d):
    """For each penalty of the grid, the gradient of the penalised squared error
    along every feature and the constant at its fit: all vanish."""
    rows = _vectors_with_label(spark, d)
    probes = probe.probe_grid(rows, (0.0, 0.01, 0.1))
    outputs = F.array(*[F.struct(F.lit(p.penalty).alias("reg"), p.output().alias("logit")) for p in probes])
    terms = rows.select("label", "features", F.inline(outputs))
    terms = terms.select("reg", "label", "logit", F.posexplode(F.array_append("features", F.lit(1.0))).alias("feature", "x"))
    pull = terms.groupBy("reg", "feature").agg(F.avg((F.col("label") - F.col("logit")) * F.col("x")).alias("pull"), F.count("*").alias("n"))
    weights = F.create_map(*[x for p in probes for x in (F.lit(p.penalty), F.lit([float(w) * p.penalty for w in p.coefficients] + [0.0]))])
    held = F.get(F.element_at(weights, F.col("reg")), F.col("feature"))
    return pull.select("reg", "feature", r6(F.abs(F.col("pull") - held)).alias("gradient"), "n")


@query
def best_probe(spark, d):
    rows = materialise(sampling.train_test_split(_vectors_with_label(spark, d), "vec_id"), "vectors")
    _, _, found = probe.best_probe(rows.where("split = 'train'"), rows.where("split = 'test'"))
    return found.select("reg", *[r6(c).alias(c) for c in ("precision", "recall", "f1_macro", "accuracy")])


@query
def train_quality(spark, d):
    """Good and bad samples to a trained text probe; its held-out report."""
    docs = fx.labelled_documents(spark, d)
    sample = train_probe.labelled_sample(docs.where("quality = 1"), docs.where("quality = 0"), "doc_id", 500)
    found = train_probe.train_quality_probe(sample).report
    return found.select("name", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query
def score_corpus(spark, d):
    """Scores of a probe that was saved and loaded again."""
    path = scratch_path(spark, "probe")
    probe.save_model(spark, probe.text_probe(_texts_with_label(spark, d)), path)
    scored = probe.score_corpus(fx.documents(spark, d, "doc_id", "text"), probe.load_model(spark, path))
    return scored.select("doc_id", r6("score", 4).alias("score"))


@query
def domain_classify(spark, d):
    rows = fx.embeddings(spark, d)
    centroids = pooling.mean_pool(rows, "label", "embedding")
    return probe.centroid_domains(rows, centroids).select("vec_id", "domain", r6("p").alias("p"))


@query
def domain_regression(spark, d):
    rows = probe.vector_features(fx.embeddings(spark, d))
    model = probe.domain_model(rows.select("features", F.col("label").cast("double").alias("domain")))
    return probe.domains(rows, model).select("vec_id", F.col("class").cast("int").alias("class"))


# --- retrieval -------------------------------------------------------------

QUALITY_MODELS = ("m1", "m2", "m3")


def queries_and_corpus(spark, d):
    """The held-out side of the seeded split asks, all other vectors answer."""
    rows = fx.embeddings(spark, d)
    asked = sampling.test_side(F.col("vec_id"))
    queries = rows.where(asked).select(F.col("vec_id").alias("query_id"), "embedding", "label")
    corpus = rows.where(~asked).select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    return queries, corpus


def judged_run(spark, d, k: int = 50) -> DataFrame:
    """Top-k with task, relevance (same label), number of relevant documents
    and one quality per model."""
    queries, corpus = queries_and_corpus(spark, d)
    run = rerank_eval.retrieve(queries, corpus, k)
    per_label = corpus.groupBy("label").agg(F.count("*").alias("n_relevant"))
    asked = queries.select("query_id", F.col("label").alias("query_label")).join(
        per_label, F.col("query_label") == F.col("label"), "left"
    )
    logits = [
        probability.sigmoid(fx.fixed_logit(i + 1)).alias(f"q_{m}")
        for i, m in enumerate(QUALITY_MODELS)
    ]
    docs = corpus.select("doc_id", F.col("label").alias("doc_label"), *logits)
    return (
        run.join(asked.drop("label"), "query_id")
        .join(docs, "doc_id")
        .withColumn("rel", (F.col("doc_label") == F.col("query_label")).cast("int"))
        .withColumn("task", F.col("query_label") % 3)
        .withColumn("n_relevant", F.coalesce("n_relevant", F.lit(0)))
    )


@query
def dense_topk(spark, d):
    queries, corpus = queries_and_corpus(spark, d)
    return retrieval.dense_topk(queries, corpus).select("query_id", "doc_id", "rank", r6("sim").alias("sim"))


@query
def topk_normalise(spark, d):
    run = retrieval.normalise_quality(judged_run(spark, d).withColumn("quality", F.col("q_m1")))
    return run.select("query_id", "doc_id", r6("quality").alias("quality"))


@query
def quality_rerank(spark, d):
    run = retrieval.normalise_quality(judged_run(spark, d).withColumn("quality", F.col("q_m1")))
    return retrieval.rerank(run, 0.98).select("query_id", "doc_id", "rank", r6("score").alias("score"))


def _rounded_metrics(found: DataFrame) -> DataFrame:
    names = ("ndcg", "map", "recall", "precision", "mrr")
    return found.select(*[r6(c).alias(c) if c in names else F.col(c) for c in found.columns])


@query
def ranking_metrics(spark, d):
    return _rounded_metrics(retrieval.ranking_metrics(judged_run(spark, d), 10, ("task",)))


@query
def rerank_sweep(spark, d):
    qualities = {m: F.col(f"q_{m}") for m in QUALITY_MODELS}
    return _rounded_metrics(rerank_eval.evaluate(judged_run(spark, d), qualities))


@query
def save_predictions(spark, d):
    path = scratch_path(spark, "predictions")
    run = judged_run(spark, d)
    ranked = retrieval.sweep(run, {m: F.col(f"q_{m}") for m in QUALITY_MODELS}, rerank_eval.QUALITY_WEIGHTS)
    tables.write_predictions(ranked.select("query_id", "doc_id", "rank", "model", "quality_p", "task"), path)
    return spark.read.schema("query_id BIGINT, doc_id BIGINT, rank INT, model STRING, quality_p DOUBLE, task INT").parquet(path)


# --- whole jobs ------------------------------------------------------------


@query
def clean_corpus(spark, d):
    """Raw pages to clean English pages."""
    raw = fx.pages(spark, d, "page_id", "url", "html")
    listed = materialise(fx.blocklist(spark, d), "blocklist")
    cleaned = cleaning.clean_pages(raw, listed, language_model(spark, d), curated_urls=fx.curated_urls(spark, d))
    return cleaned.select("page_id", "url", "text")


@query
def clean_warc(spark, d):
    """WARC records to clean English pages."""
    listed = materialise(fx.blocklist(spark, d), "blocklist")
    cleaned = cleaning.clean_warc(fx.warc_records(spark, d), listed, language_model(spark, d))
    return cleaned.select("url", "text")
