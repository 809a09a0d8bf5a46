"""The prefix trie against a plain construction, with turns and conversations that are odd in every way."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from datumloom.llm import conversation_trie as ct

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FIELDS = "conv_id long, turn long, role string, text string, node string, Turn string, depth int"


def by_hand(rows, rebuild=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, key, (role, text)))
    own = {c: [t[3] for t in sorted(turns)] for c, turns in own.items()}
    made = {}
    for c, turns in own.items():
        base = c - c % 20 if c >= 0 else c + (-c) % 20
        h = zlib.crc32(str(c).encode()) % 4 if rebuild and base != c else 0
        made[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(set)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].add(c)
    words = {p: len(WORDS.findall(p[-1][1])) if p else 0 for p in members}
    out = []
    for path, who in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in members if len(p) == len(path) + 1 and p[: len(path)] == path]
        leaves = [p for p in below if not any(q[: len(p)] == p and len(q) > len(p) for q in members)]
        ends = ",".join(map(str, sorted(c for c in who if made[c] == path)))
        parent = min(members[path[:-1]]) if path else None
        saved = sum((len(members[p]) - 1) * words[p] for p in below)
        out.append((min(who), len(path), parent, len(who), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], FIELDS)


def built(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def odd_turns():
    rows = []
    for c in range(70):
        if c in (20, 33):  # a first conversation is absent
            continue
        for t in range(c * 7 % 6):
            rows.append((c, t, ["user", "assistant"][t % 2], f"turn {t} of {c % 3 if t else 'all'}  \n words"))
    rows += [
        (80, None, None, None),
        (80, 1, "", ""),
        (80, 1, "user", "equal turns"),
        (80, 1, "user", "equal turns"),
        (80, 1, None, "equal turns"),
        (81, None, "", ""),
        (83, 0, "user", "Ünïcödé 日本語   🙂 \x1c"),
        (None, 0, "user", "no conversation"),
        (-21, 0, "user", "below zero"),
        (-20, 5, "user", "below zero"),
        (100, 0, "ab", "c"),
        (120, 0, "a", "bc"),
    ]
    return rows + [(140, t, "user", f"long {t % 5}") for t in range(3000)]


def test_trie_equals_one_made_by_hand(spark, odd_turns):
    rows = [r for r in odd_turns if r[0] != 140]
    turns = ct.turns_of(table(spark, rows).repartition(5))
    assert built(ct.trie(ct.with_shared_heads(turns))) == by_hand(rows)
    assert built(ct.trie(ct.as_they_are(turns))) == by_hand(rows, rebuild=False)


def test_a_long_conversation_goes_through_many_batches(spark, odd_turns):
    rows = [r for r in odd_turns if r[0] == 140]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = built(ct.trie(ct.as_they_are(ct.turns_of(table(spark, rows)))))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 3001
    assert all(r[3] == 1 and r[6] == 0 and r[5] == 1 for r in got)


def test_a_conversation_that_most_repeat(spark):
    rows = [(c, t, "user", f"same {t} words here") for c in range(0, 6000, 20) for t in range(3)] + [(7, 0, "user", "own")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = built(ct.trie(ct.with_shared_heads(ct.turns_of(table(spark, rows)))))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == by_hand(rows)


def test_an_empty_table_has_no_root(spark):
    assert built(ct.trie(ct.with_shared_heads(ct.turns_of(table(spark, []))))) == []


def test_partitions_do_not_change_the_trie(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    one, many = (built(ct.trie(ct.with_shared_heads(ct.turns_of(turns.repartition(n))))) for n in (1, 9))
    assert one == many == by_hand([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])
