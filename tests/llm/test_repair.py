"""Conversation repair against a search over all edit sequences."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gleaner.llm import conversation_repair as repair

SHAPE = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, conv STRING, audit STRING, _turn STRING, place INT"
SPACE = " \t\n\x0b\x0c\r"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        part = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if part == 0:
            continue
        if part == 1:
            text = ""
        if part == 2:
            text = "".join(c for c in text if c not in ".!?")
        if part == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if part == 3 else 1)
    return out


def brute_paths(rows):
    """Cheapest (cost, audit, repaired) of all edit sequences, by a plain search
    that keeps every state's best (cost, audit string)."""
    best = {"": (0, "", ())}  # by role initials so far, cut to what matters

    def short(roles):
        return roles if roles in ("", "s") else "x" + roles[-1]

    def offer(into, roles, item):
        key = short(roles)
        if key not in into or item[:2] < into[key][:2]:
            into[key] = item

    def full(key):
        return {"": "", "s": "s", "xu": "u", "xa": "a"}[key]

    def follows(key):
        return "assistant" if key == "xu" else "user"

    def inserted(states):
        for _ in range(3):
            new = dict(states)
            for key, (cost, audit, said) in states.items():
                role = follows(key)
                offer(new, "x" + role[0], (cost + 5, audit + "I", (*said, f"{role}:")))
            states = new
        return states

    for role, text, fault in rows:
        after = {}
        for key, (cost, audit, said) in inserted(best).items():
            offer(after, key, (cost + 2, audit + "D", said))
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 if fault == "truncated" else 0
            if role[:1] == "s" and key == "":
                offer(after, "s", (cost + extra, audit + "K", (*said, f"{role}:{text}")))
            new = follows(key)
            if role[:1] == new[0]:
                offer(after, "x" + new[0], (cost + extra, audit + "K", (*said, f"{role}:{text}")))
            offer(after, "x" + new[0], (cost + 1 + extra, audit + "R", (*said, f"{new}:{text}")))
        best = after
    ended = inserted(best)
    return min((ended[k] for k in ("", "xa") if k in ended), key=lambda x: x[:2])


def exhaustive(rows):
    """The same by all words over the edits, for very short conversations."""
    found = None
    for gaps in itertools.product(range(3), repeat=len(rows) + 1):
        for letters in itertools.product("DKR", repeat=len(rows)):
            choices = [("user", "assistant") if x == "R" else ("",) for x in letters]
            for roles in itertools.product(*choices, *[("user", "assistant")] * sum(gaps)):
                reroles, inserts = list(roles[: len(rows)]), list(roles[len(rows) :])
                cost, audit, said = 0, "", []
                for i in range(len(rows) + 1):
                    for _ in range(gaps[i]):
                        cost, audit = cost + 5, audit + "I"
                        said.append((inserts.pop(0), ""))
                    if i == len(rows):
                        break
                    role, text, fault = rows[i]
                    audit += letters[i]
                    if letters[i] == "D":
                        cost += 2
                        continue
                    if fault in ("blank", "duplicate"):
                        cost += 10**6
                    cost += (5 if fault == "truncated" else 0) + (letters[i] == "R")
                    said.append((reroles[i] or role, text))
                initials = "".join(r[:1] for r, _ in said)
                rest = initials[1:] if initials[:1] == "s" else initials
                if (initials and not rest) or rest != "ua" * (len(rest) // 2):
                    continue
                item = (cost, audit, tuple(f"{r}:{t}" for r, t in said))
                found = item if found is None or item[:2] < found[:2] else found
    return found


def faulted(rows):
    """``(role, text, fault)`` of rows in order."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def brute(rows):
    convs = {}
    for conv, *_ in rows:
        convs.setdefault(conv, [])
    for conv, turn, role, text in brute_damage(rows):
        convs[conv].append((turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest(), text))
    out = {}
    for conv, found in convs.items():
        found.sort()
        known = faulted([(r[2], r[4]) for r in found])
        turns = [r[1] for r in found if r[0]]
        cost, audit, said = brute_paths(known)
        kinds = [k for *_, k in known]
        initials = [r[:1] for r, *_ in known]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(said).encode()).hexdigest()
        out[conv] = (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, digest)
    return out


def conversation(draw, conv, length):
    texts = ["A text.", "Another one!", "Is it?", "cut off", "", " \t\n", None, "One more. ", "Ends. No", "é 日本."]
    roles = ["user", "assistant", "system", "user", "assistant", None, "tool", "", "User"]
    turn, rows = draw.randrange(-2, 3), []
    for i in range(length):
        turn += draw.choice([1, 1, 1, 2, 0])
        text = draw.choice(texts)
        if text and draw.random() < 0.7:
            text = f"{i} {text}"
        rows.append((conv, None if draw.random() < 0.05 else turn, draw.choice(roles[: draw.choice([2, 3, 9])]), text))
    return rows


@pytest.fixture(scope="module")
def messages():
    draw = random.Random(3)
    rows = [r for conv in range(150) for r in conversation(draw, conv, draw.randrange(1, 12))]
    rows += conversation(draw, None, 9) + conversation(draw, 1000, 700)
    rows += [(2000, 1, "user", "The same."), *[(2000, 2, "assistant", "And again.")] * 90, (2000, 3, "user", "The same.")]
    rows += [(3000 + i, 0, "user", "All of it goes.") for i in range(60)]  # some have no row left
    return rows


def report(spark, rows, parts=5):
    frame = spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], SHAPE).repartition(parts)
    return repair.repair_report(repair.damaged(frame), every=frame)


def test_search_of_short_conversations():
    draw = random.Random(1)
    for _ in range(40):
        roles = [draw.choice(["user", "assistant", "system", "tool"]) for _ in range(draw.randrange(0, 4))]
        rows = [(r, f"t{i}", draw.choice(["blank", "duplicate", "truncated", None, None])) for i, r in enumerate(roles)]
        assert brute_paths(rows) == exhaustive(rows), rows


def test_every_conversation(spark, messages):
    got = {r["conv_id"]: tuple(r)[1:] for r in report(spark, messages).collect()}
    assert got == brute(messages)
    assert any(v[6] == "" and v[5] == 0 for v in got.values())  # a conversation without rows


def test_long_conversation_in_many_tasks(spark, messages):
    rows = [r for r in messages if r[0] in (1000, 2000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["conv_id"]: tuple(r)[1:] for r in report(spark, rows, 3).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute(rows)


def test_messages_match_their_digest(spark, messages):
    frame = repair.damaged(spark.createDataFrame([(*r, "x", "y", "z", 1) for r in messages], SHAPE))
    said = {}
    for r in repair.repaired(frame).orderBy("conv_id", "place").collect():
        said.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for conv, row in brute(messages).items():
        assert hashlib.sha256("\n".join(said.get(conv, [])).encode()).hexdigest() == row[-1]


def test_rank_of_letters_keeps_ties(monkeypatch):
    draw = random.Random(5)
    for segment in (1, 2, 3):
        monkeypatch.setattr(repair, "SEGMENT", segment)
        for _ in range(60):
            rows = [(draw.choice("suaut"), draw.random() < 0.2, draw.random() < 0.3) for _ in range(draw.randrange(1, 14))]
            path = repair.Paths(repair.BEGIN)
            for row in rows:
                path.add(*row)
            cost, digits = repair.closed(path.ends())
            names = {"s": "system", "u": "user", "a": "assistant", "t": "tool"}
            known = [(names[i], str(n), "blank" if d else "truncated" if c else None) for n, (i, d, c) in enumerate(rows)]
            assert (cost, digits.translate(repair.LETTERS)) == brute_paths(known)[:2]


def test_nothing(spark):
    frame = spark.createDataFrame([], SHAPE)
    assert repair.repair_report(repair.damaged(frame), every=frame).collect() == []
    assert repair.repaired(frame).collect() == []


def test_query_is_whole(spark):
    from gleaner.llm.queries import REGISTRY

    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = REGISTRY["op13_conversation_repair"](spark, folder)
    got = {r["conv_id"]: tuple(r)[1:] for r in found.collect()}
    assert got == brute(rows)
    assert found.where(F.col("cost") > 0).count() > 0
