"""Quality rules, quality classifier, toxicity and personal data."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import pii, quality_classifier, quality_rules, textstats, toxicity

WORD = re.compile(r"[^\x20\t-\r]+")


def base_counts(text):
    own = WORD.findall(text or "")
    windows = Counter(tuple(own[i : i + 8]) for i in range(len(own) - 7))
    covered = {j for i in range(len(own) - 7) if windows[tuple(own[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(own), sum(map(len, own)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_base_counts(docs, rows, no_docs):
    found = quality_rules.quality_rules(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((str(r["doc_id"]), *(r[n] for n in names)) for r in found) == sorted((str(i), *base_counts(t)) for i, t, *_ in rows)
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.quality_rules(no_docs).count() == 0


def test_keep_good_agrees_with_the_verdicts(docs, no_docs):
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    want = sorted(str(r["doc_id"]) for r in quality_rules.quality_rules(docs).where("kept").collect())
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == want
    assert quality_rules.keep_good(no_docs).count() == 0


def test_outliers_of_a_language_and_source(spark):
    rnd = random.Random(2)
    text = lambda end: " ".join(f"{'ab' * rnd.randrange(1, 4)}{rnd.randrange(99)}{end}" for _ in range(60))
    rows = [(i, text("###" if i % 10 == 0 else ""), "en", "a") for i in range(400)]
    rows += [(1000 + i, text("|" if i % 2 else "|"), "en", "symbols") for i in range(150)]  # normal for its source
    found = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING"))
    kept = {r["doc_id"] for r in found.where("kept").collect()}
    assert kept == {i for i in range(400) if i % 10} | {1000 + i for i in range(150)}


def test_each_statistic_alone_rejects(spark):
    """One planted text per statistic among clean ones; repeated windows are the
    base limit's, below which clean texts have them too."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(3, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    passage = line(14)
    planted = {
        "length": " ".join(word() * 12 for _ in range(60)),
        "symbols": " ".join(word() + "###" for _ in range(60)),
        "lines": "\n".join(f"{line(4)}\nmore\nnext\ntop" for _ in range(15)),
        "repeats": f"{passage}\n{line(32)}\n{passage}",
        "upper": line(60).upper(),
        "neighbours": " ".join(f"{w} {w}" for w in line(30).split()),
    }
    clean = f"{passage}\n{line(36)}\n{line(40)}\n{passage}"  # a quarter of its lines and words
    rows = [(i, "\n".join(line(20) for _ in range(4)), "en", "a") for i in range(300)] + [(-1, clean, "en", "a")]
    rows += [(1000 + i, t, "en", "a") for i, t in enumerate(planted.values())]
    found = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING")).collect()
    assert [r["doc_id"] for r in found if r["kept"] and r["doc_id"] >= 1000] == []
    assert [r["doc_id"] for r in found if r["base_failed"]] == [1000 + list(planted).index("repeats")]
    assert {r["doc_id"] for r in found if r["kept"]} == {-1, *range(300)}


def brute_mcd(x, share, steps):
    """The same concentration steps with exact quantiles."""
    floors = np.array(list(quality_rules.FLOORS.values()))
    centre = np.median(x, 0)
    spread = np.maximum(1.4826 * np.median(np.abs(x - centre), 0), floors)
    inverse = np.diag(1 / spread**2)
    for _ in range(steps):
        d = np.einsum("ij,jk,ik->i", x - centre, inverse, x - centre)
        near = x[np.argsort(d)[: math.ceil(len(x) * share)]]
        centre = near.mean(0)
        inverse = np.linalg.inv(np.cov(near.T, bias=True) + np.diag(floors**2))
    return centre, inverse


def test_estimates_resist_outliers(spark):
    rnd = np.random.default_rng(4)
    good = rnd.multivariate_normal(np.full(5, 1.0), 0.05 * (np.eye(5) + 0.5), 900)
    x = np.concatenate([good, rnd.normal(4.0, 0.1, (180, 5))])
    rows = spark.createDataFrame([("en", "a", r) for r in x.tolist()], "lang STRING, source STRING, x ARRAY<DOUBLE>").repartition(6)
    model = quality_rules.fit(rows).collect()
    assert len(model) == 1
    centre, inverse = brute_mcd(x, quality_rules.SHARE, quality_rules.STEPS)
    assert np.abs(np.array(model[0]["centre"]) - centre).max() < 0.02
    full = np.zeros((5, 5))
    for v, (i, j) in zip(model[0]["inverse"], quality_rules._PAIRS, strict=True):
        full[i, j] = full[j, i] = v
    assert np.abs(full - inverse).max() / np.abs(inverse).max() < 0.1


def test_boosted_trees():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(3000, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = quality_classifier.fit_trees(x[:2000], y[:2000])
    score = model.score(x[2000:])
    assert ((score > 0.5) == y[2000:]).mean() > 0.97

    def walk(row):  # one row at a time
        total = model.base
        for feature, cut, leaf in zip(model.feature, model.cut, model.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > cut[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + math.exp(-total))

    assert score[:50] == pytest.approx([walk(r) for r in x[2000:2050]])
    constant = quality_classifier.fit_trees(x[:0], y[:0])
    assert constant.score(x[:3]) == pytest.approx([0.5] * 3)


def test_quality_classifier_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held_out = quality_classifier.remainder(F.col("doc_id"), 4) == 2
    model = quality_classifier.fit(docs, labels.where(~held_out))
    rows = quality_classifier.scored(docs, model).join(labels, "doc_id").where(held_out).toPandas()
    good, bad = rows[rows.quality == 1].score, rows[rows.quality == 0].score
    assert np.mean([a > b for a, b in itertools.product(good, bad)]) > 0.97
    assert (rows[rows.quality == 1].predicted == 1).mean() > 0.95


def test_classifiers_on_awkward_rows(spark, docs, rows, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (6, 0), (None, 1), (12, 1), (7, None)], "doc_id BIGINT, quality INT")
    found = quality_classifier.scored(docs, quality_classifier.fit(docs, labels)).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    model = quality_classifier.fit(no_docs, labels)
    assert quality_classifier.scored(no_docs, model).count() == 0
    toxic = labels.withColumnRenamed("quality", "toxic")
    machine = toxicity.fit(docs, toxic)
    found = toxicity.scored(docs, machine).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    machine = toxicity.fit(no_docs, toxic)
    assert len(toxicity.scored(docs, machine).collect()) == len(rows)


def test_string_kernel():
    strings = ["<idiot>", "<id-iot>", "<banana>", "<nab>", "<aaaaaa>"]
    got = toxicity.kernel(strings, strings)

    def plain(s, t):
        return sum(
            toxicity.DECAY ** (a[-1] - a[0] + b[-1] - b[0] + 2)
            for a in itertools.combinations(range(len(s)), toxicity.ORDER)
            for b in itertools.combinations(range(len(t)), toxicity.ORDER)
            if all(s[i] == t[j] for i, j in zip(a, b, strict=True))
        )

    want = [[plain(s, t) / math.sqrt(plain(s, s) * plain(t, t)) for t in strings] for s in strings]
    assert got == pytest.approx(np.array(want), abs=1e-4)


def test_toxicity_of_planted_insults(spark):
    rnd = random.Random(8)
    clean = ["".join(rnd.choice(["ka", "lo", "mi", "ten", "ru", "so", "pa"]) for _ in range(rnd.randrange(1, 4))) for _ in range(300)]
    insults = ["blockhead", "numbskull", "dimwitted"]

    def text(bad):
        own = [rnd.choice(clean) for _ in range(40)]
        if bad:
            own[rnd.randrange(40)] = rnd.choice(insults)
        return " ".join(own[:20]) + ". " + " ".join(own[20:])

    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, toxic INT")
    machine = toxicity.fit(table.select("doc_id", "text"), table.where("doc_id < 400").select("doc_id", "toxic"))
    found = toxicity.scored(table, machine).join(table, "doc_id").where("doc_id >= 400")
    assert found.where("toxic <> predicted").count() == 0
    odd = machine.margins([u for t in ("blockkhead", "num-bskull", "dimxwitted") for u in toxicity.units(t)])
    plain = machine.margins([u for t in clean for u in toxicity.units(t)])
    assert odd.min() > plain.max()


EXACT = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def exact_spans(text):
    out = {}
    for kind, pattern in EXACT.items():
        out[kind] = []
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                "card": 16 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0,
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out[kind].append(m.span())
    return out


def test_base_spans():
    rnd = random.Random(3)
    for _ in range(4000):
        text = "".join(rnd.choice("ab1 .@+-()2345\n%9 .@é") for _ in range(40))
        assert pii.base_spans(text) == exact_spans(text)
    for text in ("4111 1111 1111 1111", "x" * 50_000 + "@a.b", "9" * 20_000, "1.2.3.4.5.6.7.8", "+" * 1000 + "1 234 567 890"):
        assert pii.base_spans(text) == exact_spans(text)


@pytest.mark.parametrize("span", ["jo@example (dot) com", "jo@example[DOT]com", "jo (At) example (Dot) com", "jo[aT]example.com", "jo@mail.example.com"])
@pytest.mark.parametrize("rest", ["", " or (at) noon", " (dot)", " at noon"])
def test_spelled_addresses_do_not_depend_on_the_rest(span, rest):
    text = f"write to {span} now{rest}"
    found = {text[a:b] for _, a, b, *_ in pii.candidates(text, pii.base_spans(text))}
    assert span in found


def test_personal_data(docs, rows, no_docs):
    found = pii.personal_data(docs).collect()
    want = []
    for i, t, *_ in rows:
        spans = exact_spans(t or "")
        written = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in spans[k])
        want.append((str(i), *(len(spans[k]) for k in pii.KINDS), hashlib.sha256(written.encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), *(r[f"n_{k}"] for k in pii.KINDS), r["base_sha256"]) for r in found) == sorted(want)
    by_id = {r["doc_id"]: r for r in found}
    assert len(by_id[15]["spans"].split(",")) == 4
    assert pii.personal_data(no_docs).count() == 0


def test_reliabilities_and_added_spans(spark):
    rnd = random.Random(5)
    digits = lambda n: "".join(str(rnd.randrange(10)) for _ in range(n))
    texts = [f"call +1 ({digits(3)}) 555-{digits(4)} now" for _ in range(120)]
    texts += [f"phone ({rnd.randrange(200, 999)}) 555-{digits(4)} now" for _ in range(80)]  # without the plus sign
    texts += [f"serial {digits(11)} of page {digits(3)}" for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    found = {r["doc_id"]: r for r in pii.personal_data(docs).collect()}
    assert all(found[i]["n_phone"] == 1 for i in range(120))
    assert sum(bool(found[i]["spans"]) for i in range(120, 200)) > 70
    assert not any(found[i]["spans"] for i in range(200, 280))


def planted(rnd):
    """Texts with forms that the base patterns miss, by kind, with the form; texts
    with base forms; and texts of neither kind that look alike."""
    digits = lambda n: "".join(str(rnd.randrange(10)) for _ in range(n))
    name = lambda: "".join(rnd.choice("abcdefghik") for _ in range(6))
    fill = lambda n: " ".join("".join(rnd.choice("lmnoprstuv") for _ in range(5)) for _ in range(n))

    def card(n, start):
        body = start + digits(n - len(start) - 1)
        return next(body + str(d) for d in range(10) if pii.luhn(body + str(d)))

    hidden, plain, clean = [], [], []
    for _ in range(60):
        c, a = card(16, "4"), card(15, "37")
        six = ":".join("%x" % rnd.randrange(1, 65536) for _ in range(8))
        hidden += [
            ("email", f"{name()} [at] {name()} [dot] com"), ("email", f"{name()} (at) mail.{name()}.org"), ("email", f"{name()} @ {name()} . com"),
            ("ip", six), ("ip", f"fe80::{rnd.randrange(1, 9999):x}:{rnd.randrange(1, 9999):x}"),
            ("card", f"{c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]}"), ("card", f"{c[:4]}  {c[4:8]}  {c[8:12]}  {c[12:]}"), ("card", f"{a[:4]} {a[4:10]} {a[10:]}"),
            ("phone", f"({digits(3)}) {rnd.randrange(200, 999)}-{digits(4)}"), ("phone", f"{rnd.randrange(200, 999)}.{digits(3)}.{digits(4)}"),
            ("phone", f"00{rnd.choice(['49', '33', '44'])} {rnd.randrange(20, 99)} {rnd.randrange(10**6, 10**7)}"),
            ("phone", f"({rnd.randrange(200, 999)}) {digits(3)}-{digits(4)} ext. {digits(2)}"),
        ]
        plain += [f"{name()}@{name()}.com", f"10.{rnd.randrange(256)}.3.{rnd.randrange(256)}", f"{c[:4]} {c[4:8]} {c[8:12]} {c[12:]}", f"+1 ({rnd.randrange(200, 999)}) 555-{digits(4)}"]
        bad = next(x for x in (f"{rnd.randrange(1000, 1999)}{digits(12)}" for _ in range(99)) if not pii.luhn(x))
        clean += [
            f"at {rnd.randrange(24)}:{rnd.randrange(10, 60)}:{rnd.randrange(10, 60)} sharp", ":".join(f"{rnd.randrange(256):02x}" for _ in range(6)),
            f"order {bad[:4]} {bad[4:8]} {bad[8:12]} {bad[12:]}", f"isbn 978-3-{digits(2)}-{digits(6)}-{digits(1)}", f"on 20{digits(2)}-0{rnd.randrange(1, 10)}-1{digits(1)}",
            f"serial {digits(11)}", f"@{name()} said", f"pages {rnd.randrange(100, 999)}-{digits(4)}", f"{rnd.randrange(10, 28)}.0{rnd.randrange(1, 10)}.2019",
        ]
    words = {"email": "mail to", "ip": "server", "card": "card", "phone": "call"}
    texts = [(f"{fill(4)} {words[k] if i % 2 else 'see'} {form} {fill(3)}", k, form) for i, (k, form) in enumerate(hidden)]
    return texts, [f"{fill(4)} {form} {fill(3)}" for form in plain], [f"{fill(4)} {form} {fill(3)}" for form in clean]


def test_added_spans_of_planted_forms(spark, capsys):
    hidden, plain, clean = planted(random.Random(9))
    texts = [t for t, *_ in hidden] + plain + clean
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    spans = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs).collect()}
    hit, total = {}, {}
    for i, (text, kind, form) in enumerate(hidden):
        at = text.index(form)
        total[kind] = total.get(kind, 0) + 1
        hit[kind] = hit.get(kind, 0) + any(
            k == kind and int(a) < at + len(form) and at < int(b) and int(b) - int(a) >= 0.8 * len(form) for k, a, b in (x.split(":") for x in spans[i].split(",") if x)
        )
    model = pii.fit(pii.found_spans(docs))
    with capsys.disabled():
        print("\nrecall of forms that the base patterns miss:", {k: round(hit[k] / total[k], 3) for k in total})
        for kind, table in sorted(model.reliability.items()):
            print(pii.KINDS[kind], {n: [round(float(table[j, c, 2]), 2) for c in (1, 0)] for j, n in enumerate(pii.LABELERS)}, "(votes for, of personal and other spans)")
    assert all(hit[k] >= 0.9 * total[k] for k in total), hit
    first = len(hidden)
    assert all(len(spans[first + i].split(",")) == 1 and spans[first + i] for i in range(len(plain)))
    wrong = [texts[i] for i in range(first + len(plain), len(texts)) if spans[i]]
    assert not wrong, (len(wrong), wrong[:5])


def test_long_base_spans_are_not_overlapped():
    model = pii.SpanModel({}, {3: np.full(len(pii._design(np.array([0]))[0]), 9.0)})
    item = lambda a, b, base: {"kind": 3, "start": a, "end": b, "features": 0, "base": base}
    items = [item(0, 100, True), *[item(i, i + 2, True) for i in range(5, 60, 5)], item(90, 95, False), item(101, 105, False), item(104, 109, False)]
    assert pii.chosen(items, model)[1][-1] == (3, 101, 105) and len(pii.chosen(items, model)[1]) == len(items) - 2


def test_masking_takes_any_names(spark):
    rows = [(1, "mail jo@mail.example.com", "s", 3)]
    docs = spark.createDataFrame(rows, "_spans INT, text STRING, _text STRING, c0 INT")
    assert [tuple(r) for r in pii.masked(docs).collect()] == [(1, "mail <email>", "s", 3)]


def test_masking(docs, rows, no_docs):
    masked = pii.masked(docs)
    assert masked.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert texts[15] == "mail <email> or <phone>, <ip>, card <card>."
    assert texts[6] is None and texts[1] == dict((i, t) for i, t, *_ in rows)[1]
    assert pii.masked(no_docs).count() == 0


def test_statistics_ignore_slices():
    import pyarrow as pa

    texts = ["a b c d e f g h " * 3, None, "", "Line.\nLine.\n", "x " * 40]
    whole = textstats.counts(pa.array(texts))
    for i, t in enumerate(texts):
        one = textstats.counts(pa.array([t], pa.string()))
        assert all(one[k][0] == whole[k][i] for k in textstats.COUNTS)
