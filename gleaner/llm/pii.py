"""Personal data by weak supervision.

Four exact patterns give the base spans. Looser patterns propose further
candidates. On every candidate a set of labelers votes for, against or not at
all: exact and loose patterns, gazetteers (mail and host words, country codes,
card issuers), check sums and words of the context. Expectation-maximisation
over the counts of vote patterns estimates how reliable each labeler is and how
likely each candidate is personal; with these as soft labels a logistic
classifier of span features is trained. Candidates that it is sure of are added
to the base spans.

Votes and features are small integers, so the whole corpus comes down to counts
of their combinations, which have a fixed bound and are summed map-side.
"""

from __future__ import annotations

import bisect
import hashlib
import ipaddress
import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import materialise
from .words import slices, thrifty

KINDS = ("email", "ip", "card", "phone")
SURE = 0.9  # probability from which a candidate is added
ROUNDS = 60

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_RUN = re.compile(r"[^ \n]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Candidates: addresses with the signs spelled out, and digits in groups.
_SPELLED = re.compile(
    r"[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*(?:@| ?[(\[](?i:at)[)\]] ?)[A-Za-z0-9-]+"
    r"(?:(?:\.| ?[(\[](?i:dot)[)\]] ?)[A-Za-z0-9-]+)+"
)
_SPACED = re.compile(r"[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)* ?@ ?[A-Za-z0-9-]+(?: ?\. ?[A-Za-z0-9-]{2,})+")
_COLONS = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,8}[0-9A-Fa-f]{0,4}(?![\w:])")
_SIGN = re.compile(r"[(\[](?i:at|dot)[)\]]")  # without one, no match of _SPELLED has a space
_DIGITS = re.compile(r"(?<![A-Za-z0-9])[+(]?[0-9](?:[ ().\[\]/-]{0,3}[0-9])+(?: ?(?:ext|x)\.? ?[0-9]{1,5})?(?![A-Za-z0-9])")
# Dates and numbers of books: what looks like personal numbers and is not.
_CALENDAR = re.compile(r"(?:19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./](?:19|20)?[0-9]{2}|97[89][- ]?[0-9][0-9 -]+")

# Gazetteers, fixed values.
MAIL_WORDS = frozenset("mail email smtp gmail hotmail outlook yahoo example com org net edu info de fr es uk".split())
COUNTRY_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91".split())
CARD_ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|35")
CONTEXT = {
    "email": frozenset("email e-mail mail contact write address correo courriel".split()),
    "ip": frozenset("ip host server address login from client".split()),
    "card": frozenset("card visa mastercard amex payment credit karte carte tarjeta".split()),
    "phone": frozenset("phone tel telephone call mobile fax cell telefon telefono".split()),
}
AGAINST = frozenset("version isbn issn page pages year doi article section figure table serial id order".split())
LABELERS = ("base", "shape", "gazetteer", "check", "context", "against", "length", "calendar")
FEATURES = ("digits", "groups", "plus", "parens", "dots", "at", "spelled", "check", "context", "against", "calendar", "colons")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _is_version_six(span: str) -> bool:
    try:
        ipaddress.IPv6Address(span)
    except ValueError:
        return False
    return True


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _parts_ok(span: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in span.split("."))


def _around_at(text: str, pattern: re.Pattern):
    """Matches of a pattern that holds an ``@`` and no space or line end; only
    the runs around an ``@`` are searched."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = max(text.rfind(" ", done, at), text.rfind("\n", done, at), done - 1) + 1
        end = _RUN.match(text, at).end()
        yield from pattern.finditer(text, start, end)
        done, at = end, text.find("@", end)


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of the four patterns that pass their
    checks, in code points; a match that fails is dropped."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = [m.span() for m in _around_at(text, _EMAIL)]
    if not _ANY_DIGIT.search(text):
        return out
    out["ip"] = [m.span() for m in _IP.finditer(text) if _parts_ok(m.group())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _digits(m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


_ANY_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[\w-]+")


def _words_before(text: str, start: int) -> list[str]:
    return [w.lower() for w in _WORD.findall(text[max(0, start - 40) : start])[-3:]]


def candidates(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[int, int, int, int, int]]:
    """``(kind, start, end, votes, features)`` of the base spans and of looser
    matches; votes and features are packed numbers."""
    found = {(k, *span) for i, k in enumerate(KINDS) for span in base[k]}
    if _SIGN.search(text):
        found |= {("email", *m.span()) for m in _SPELLED.finditer(text)}
    elif "@" in text:
        found |= {("email", *m.span()) for m in _around_at(text, _SPELLED)}
    if " @" in text or "@ " in text or " . " in text:
        found |= {("email", *m.span()) for m in _SPACED.finditer(text) if "@" in m.group()}
    if ":" in text:
        found |= {("ip", *m.span()) for m in _COLONS.finditer(text)}
    if _ANY_DIGIT.search(text):
        for m in _DIGITS.finditer(text):
            n = len(_digits(m.group())) if m.end() - m.start() >= 7 else 0
            if 7 <= n <= 19:
                span = m.group()
                parts = re.findall(r"[0-9]+", span)
                four = len(parts) == 4 and max(map(len, parts)) <= 3 and span.count(".") == 3
                found.add(("ip" if four and "(" not in span else "card" if n >= 13 and not span.startswith(("+", "(", "00")) and "x" not in span else "phone", *m.span()))
    exact = {(k, *span) for k in KINDS for span in base[k]}
    out = []
    for kind, start, end in sorted(found):
        span, before = text[start:end], _words_before(text, start)
        digits = _digits(span)
        context, against = any(w in CONTEXT[kind] for w in before), any(w in AGAINST for w in before)
        if kind == "email":
            words = re.findall(r"[A-Za-z]+", span.lower())
            check, shape, listed = True, "." in span or "dot" in span.lower(), any(w in MAIL_WORDS for w in words[1:])
            length = 6 <= len(span) <= 80
        elif kind == "ip" and ":" in span:
            check, shape, listed = _is_version_six(span), "::" in span or span.count(":") == 7, len(span) > 8
            length = 8 <= len(span) <= 39
        elif kind == "ip":
            check, shape, listed = span.count(".") == 3 and _parts_ok(re.sub(r"[^0-9.]", "", span)), span.count(".") == 3, digits[:1] != "0"
            length = 4 <= len(digits) <= 12
        elif kind == "card":
            check, shape, listed = luhn(digits), re.fullmatch(r"(?:[0-9]{4}[ ./-]{0,3}){3}[0-9]{1,7}|[0-9]{4}[ ./-]{0,3}[0-9]{6}[ ./-]{0,3}[0-9]{5}", span) is not None, CARD_ISSUERS.match(digits) is not None
            length = 15 <= len(digits) <= 19
        else:
            plain = re.sub(r" ?(?:ext|x)\.? ?[0-9]+$", "", span)
            plus = span.startswith(("+", "00"))
            local = re.fullmatch(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", plain) is not None
            check = plus or local
            shape = local or re.fullmatch(r"(?:\+|00)[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,7}){1,3}", plain) is not None
            listed = plus and any(digits.lstrip("0").startswith(c) for c in COUNTRY_CODES)
            length = 8 <= len(digits) <= 15
        odd = kind != "email" and _CALENDAR.fullmatch(span) is not None
        # 0 no vote, 1 against, 2 for
        votes = (
            2 if (kind, start, end) in exact else 0,
            2 if shape else 1,
            2 if listed else 0 if kind == "phone" else 1,
            2 if check else 1,
            2 if context else 0,
            1 if against else 0,
            2 if length else 1,
            1 if odd else 0,
        )
        groups = len(re.findall(r"[0-9]+", span))
        values = (
            min(len(digits), 20), min(groups, 6), int("+" in span), int("(" in span), min(span.count("."), 4),
            int("@" in span), int(kind == "email" and "@" not in span), int(check), int(context), int(against),
            int(odd), min(span.count(":"), 4),
        )
        out.append((KINDS.index(kind), start, end, _pack(votes, 3), _pack(values, 21)))
    return out


def _pack(values, base: int) -> int:
    total = 0
    for v in values:
        total = total * base + v
    return total


def _unpack(codes: np.ndarray, base: int, n: int) -> np.ndarray:
    out = np.zeros((len(codes), n), np.int64)
    for i in range(n - 1, -1, -1):
        out[:, i], codes = codes % base, codes // base
    return out


_ITEM = "array<struct<kind:int,start:int,end:int,votes:bigint,features:bigint,base:boolean>>"


def _items(whole: str) -> list[dict]:
    base = base_spans(whole)
    exact = {(KINDS.index(k), *s) for k in KINDS for s in base[k]}
    return [
        {"kind": c[0], "start": c[1], "end": c[2], "votes": c[3], "features": c[4], "base": c[:3] in exact}
        for c in candidates(whole, base)
    ]


def found_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_spans``: the candidates of each text with votes and
    features; base spans are marked. A null text has none."""
    item = T.StructType.fromDDL(f"_spans {_ITEM}").fields[0]
    schema = T.StructType([*docs.schema.fields, item])
    arrow = pa.list_(
        pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.int64()), ("features", pa.int64()), ("base", pa.bool_())])
    )

    def run(batches):
        for part in itertools.chain.from_iterable(slices(b, text) for b in batches):
            rows = [_items(value.as_py() or "") for value in part.column(part.schema.get_field_index(text))]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, arrow)], [*part.schema.names, "_spans"])

    return docs.mapInArrow(thrifty(run), schema)


@dataclass
class SpanModel:
    """Reliability of the labelers by kind, ``P(vote | personal or not)``, and
    the weights of the classifier by kind."""

    reliability: dict[int, np.ndarray]
    weights: dict[int, np.ndarray]

    def probability(self, kind: int, features: int) -> float:
        w = self.weights.get(kind)
        if w is None:
            return 0.0
        return float(1 / (1 + np.exp(-(_design(np.array([features])) @ w)[0])))


def _design(features: np.ndarray) -> np.ndarray:
    values = _unpack(features, 21, len(FEATURES))
    one_hot = [values[:, i : i + 1] == np.arange(top + 1) for i, top in ((0, 20), (1, 6), (4, 4))]
    rest = values[:, [2, 3, 5, 6, 7, 8, 9, 10, 11]]
    return np.concatenate([np.ones((len(values), 1)), *one_hot, rest], axis=1).astype(float)


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each vote pattern, and ``P(vote | class)`` as an array
    (labeler, class, vote), for labelers that err independently."""
    patterns = _unpack(votes, 3, len(LABELERS))
    score = (patterns == 2).sum(1) - (patterns == 1).sum(1) + (patterns[:, 0] == 2)
    posterior = 1 / (1 + np.exp(-1.5 * (score - 2.0)))
    table = np.zeros((len(LABELERS), 2, 3))
    for _ in range(ROUNDS):
        weight = np.stack([(1 - posterior) * counts, posterior * counts])
        for j in range(len(LABELERS)):
            for v in range(3):
                table[j, :, v] = weight[:, patterns[:, j] == v].sum(1)
        table = (table + 0.5) / (table + 0.5).sum(2, keepdims=True)
        prior = (weight.sum(1) + 1) / (weight.sum() + 2)
        logs = np.log(prior)[:, None] + sum(np.log(table[j][:, patterns[:, j]]) for j in range(len(LABELERS)))
        posterior = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    return posterior, table


def _logistic(x: np.ndarray, y: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ridge logistic regression on soft labels, by Newton steps. Labels carry
    half a count against, so that a class without counter-examples stays finite."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (counts * (y - p)) - 0.1 * w
        hessian = (x * (counts * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w + step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
    return w


def fit(spans: DataFrame) -> SpanModel:
    """From rows with ``_spans``: counts of (kind, votes, features), of which
    there are at most as many as combinations of the coded values."""
    rows = spans.select(F.explode("_spans").alias("s")).groupBy("s.kind", "s.votes", "s.features").agg(F.count("*").alias("n"))
    table = rows.orderBy("kind", "votes", "features").toPandas()
    reliability, weights = {}, {}
    for kind, part in table.groupby("kind"):
        patterns = part.groupby("votes")["n"].sum()
        posterior, reliability[int(kind)] = expectation_maximisation(patterns.index.to_numpy(np.int64), patterns.to_numpy(float))
        label = part["votes"].map(dict(zip(patterns.index, posterior, strict=True))).to_numpy(float)
        weights[int(kind)] = _logistic(_design(part["features"].to_numpy(np.int64)), label, part["n"].to_numpy(float))
    return SpanModel(reliability, weights)


def chosen(items: list[dict], model: SpanModel, sure: float = SURE) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, by kind and start. A candidate is added if the
    classifier is sure of it and it overlaps no span chosen before, base ones first."""
    base = [(s["kind"], s["start"], s["end"]) for s in items if s["base"]]
    taken, added = sorted((a, b) for _, a, b in base), []
    reach = list(itertools.accumulate((b for _, b in taken), max))  # the largest end so far
    for s in sorted((s for s in items if not s["base"]), key=lambda s: (s["start"], -s["end"], s["kind"])):
        if model.probability(s["kind"], s["features"]) >= sure:
            at = bisect.bisect_left(taken, (s["end"],))  # those that start before its end
            if at == 0 or reach[at - 1] <= s["start"]:
                taken.insert(at, (s["start"], s["end"]))
                reach[at:] = itertools.accumulate((b for _, b in taken[at:]), max, initial=reach[at - 1] if at else 0)
                reach.pop(at)
                added.append((s["kind"], s["start"], s["end"]))
    return sorted(base), sorted(base + added)


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, key="doc_id", text="text") -> DataFrame:
    """Per row of ``docs``: the key, the numbers of base spans by kind,
    ``base_sha256`` and ``spans``, all spans as ``kind:start:end``.

    A null or empty text has no spans (and the hash of the empty string). Null
    and repeated keys are passed on row by row. An empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    spans = materialise(found_spans(rows, "_text").drop("_text"), "spans")
    model = fit(spans)
    kind = rows.schema["_key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            numbers, digests, written = {k: [] for k in KINDS}, [], []
            for items in batch.column(1).to_pylist():
                base, every = chosen(items, model)
                for i, k in enumerate(KINDS):
                    numbers[k].append(sum(s[0] == i for s in base))
                digests.append(hashlib.sha256(_written(base).encode()).hexdigest())
                written.append(_written(every))
            columns = [batch.column(0), *(pa.array(numbers[k], pa.int64()) for k in KINDS), pa.array(digests, pa.string()), pa.array(written, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["_key", *KINDS, "h", "s"])

    schema = f"_key {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return spans.mapInArrow(thrifty(run), schema).withColumnRenamed("_key", key)


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs``, all columns, with each span of ``text`` replaced by its kind in
    angle brackets. Spans are searched once for the model and again where they
    are replaced, by one function, so that a task needs one Python worker; texts are
    not shuffled. A null text stays null, of spans that
    overlap the first is written, repeated rows are masked alike, an empty table
    gives no rows, and columns may have any names."""
    model = fit(materialise(found_spans(docs.select(F.col(f"`{text}`").alias("_text")), "_text").drop("_text"), "spans"))
    names, at = docs.columns, docs.columns.index(text)
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])  # whatever the names, none of them clashes
    schema = own.schema

    def run(batches):
        for batch in itertools.chain.from_iterable(slices(b, f"c{at}") for b in batches):
            out = []
            for value in batch.column(at):
                whole = value.as_py()
                if items := _items(whole or ""):
                    last, parts = 0, []
                    for kind, start, end in sorted(chosen(items, model)[1], key=lambda s: (s[1], s[2])):
                        if end <= last:
                            continue
                        parts += [whole[last : max(last, start)], f"<{KINDS[kind]}>" if start >= last else ""]
                        last = end
                    whole = "".join([*parts, whole[last:]])
                out.append(whole)
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(names))])

    return own.mapInArrow(thrifty(run), schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
