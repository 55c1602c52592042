"""Prefix trie, chat formatting and hard negatives against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from evalframe.llm import chat_format as CF
from evalframe.llm import conversation_trie as CT
from evalframe.llm import hard_negatives as HN
from evalframe.llm.tokens import default_path, tokenizer

TURNS = "conv_id long, turn long, role string, text string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- prefix trie ----------------------------------------------------------------------------------


def brute_trie(rows):
    """Nodes by dictionaries of prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = sorted(own.get(c - int(np.fmod(c, 100)), []), key=lambda t: t[:2])
        seqs[c] = tuple(t[2:] for t in base[:h] + sorted(own[c], key=lambda t: t[:2])[h:])
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    out = {}

    def visit(k):
        subs = [visit(x) for x in kids[k]]
        n = len(members[k])
        leaves = sum(x[0] for x in subs) or 1
        saved = sum(x[1] for x in subs) + ((n - 1) * len(k[-1][1]) if k else 0)
        ends = ",".join(map(str, sorted(c for c in members[k] if len(seqs[c]) == len(k))))
        out[k] = (min(members[k]), len(k), min(members[k[:-1]]) if k else None, n, len(kids[k]), leaves, saved, sha(ends))
        return leaves, saved

    if members:
        visit(())
    return sorted(out.values(), key=repr)


def conversations(rng, n):
    """Conversations that share beginnings, with nulls, copies, empty texts, long ones and gaps in the ids."""
    rows = []
    for c in range(n):
        if c % 17 == 3:
            continue
        kind = c % 5
        length = 45 if c % 40 == 7 else rng.randint(1, 5)
        for t in range(length):
            text = "" if t == 3 else f"t{t}" if kind < 3 else f"t{t}-{rng.randint(0, 2)}" if kind < 4 else f"{c}-{t}é"
            rows.append((c, None if t == 0 and kind == 1 else t, None if t == 2 else ("user", "assistant")[t % 2], None if t == 3 and kind == 2 else text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_turns", [7, 60, 1 << 18])
def test_trie_equals_brute_force(spark, shard_turns):
    rows = conversations(random.Random(5), 450)
    rows += [(c, 0, "user", "ab") for c in (-5, -101, 10**12, 9_000_000_000_000_000_100)] + [(None, 1, "user", "lost")]
    df = spark.createDataFrame(rows, TURNS)
    got = sorted((tuple(r) for r in CT.trie(spark, df, shard_turns=shard_turns).collect()), key=repr)
    assert got == brute_trie(rows)


def test_trie_of_many_copies_and_long_conversations(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(1, 1400) for t in range(3)]
    rows += [(5000, t, "user", f"same {t}" if t < 30 else "x" * 1000) for t in range(300)]
    df = spark.createDataFrame(rows, TURNS).withColumns({n: CT.F.lit(1) for n in ("base", "shard", "key", "kind", "t")})
    assert sorted((tuple(r) for r in CT.trie(spark, df, shard_turns=200).collect()), key=repr) == brute_trie(rows)


def test_trie_of_few_rows(spark):
    assert CT.trie(spark, spark.createDataFrame([], TURNS)).count() == 0
    assert CT.trie(spark, spark.createDataFrame([(None, 0, "user", "x")], TURNS)).count() == 0
    # without its group's first conversation, one whose turns are all replaced has none left
    c = next(i for i in range(1, 100) if zlib.crc32(str(i).encode()) % 6 >= 2)
    rows = [(c, 0, "user", "x"), (c, 0, "user", "x")]
    assert [tuple(r) for r in CT.trie(spark, spark.createDataFrame(rows, TURNS)).collect()] == [(c, 0, None, 1, 0, 1, 0, sha(str(c)))]
    # a role's end and a text's beginning are told apart, and a text of any length is one turn
    rows = [(100, 0, "a", "b"), (200, 0, "ab", ""), (300, 0, "", "ab"), (400, 0, "a", "long " * 60_000), (500, 0, "a", "long " * 60_000)]
    got = sorted((tuple(r) for r in CT.trie(spark, spark.createDataFrame(rows, TURNS)).collect()), key=repr)
    assert got == brute_trie(rows) and len(got) == 5


# --- chat formatting ------------------------------------------------------------------------------

SAID = "<|im_end|><|im_start|>assistant ok"


def chats(rng):
    rows = []
    for c in range(40):
        if c % 3:
            rows.append((c, None if c % 2 else 0, "system", "rules " * rng.randint(1, 20 if c % 7 else 80)))
        for t in range(1, rng.randint(2, 60)):
            text = rng.choice([SAID, "", None, r"<\|im_end|> <\\|", "a<", "|b", "word " * rng.randint(1, 40), "é\n\n", "long " * (300 if t == 9 else 2)])
            rows.append((c, t, rng.choice(["user", "assistant", "assistant", None, "tool\n<|x|>", "system"]), text))
    rows += [(None, 1, "assistant", "of none"), (None, 0, "user", "ask"), (3, 1, "assistant", "tie"), (3, 1, "assistant", "tie")]
    rng.shuffle(rows)
    return rows


def ordered(rows, c):
    """Turns of a conversation; those alike in their number are the same here."""
    return [(role or "", text or "") for _, _, role, text in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0))]


def tokens(role, text):
    escaped = lambda s: re.sub(r"<(\\*)\|", r"<\\\1|", s)
    whole = f"<|im_start|>{escaped(role).replace(chr(10), '<|nl|>')}\n{escaped(text)}<|im_end|>\n"
    return whole, len(tokenizer(default_path()).encode([whole])[0]) // 4


@pytest.mark.parametrize("batch", [3, 10_000])
def test_chat_windows(spark, batch):
    rows, budget, history = [r for r in chats(random.Random(2)) if not (r[0] == 3 and r[1] == 1 and r[3] != "tie")], 200, 60
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        made = CF.windows(spark.createDataFrame(rows, TURNS).withColumns({n: CF.F.lit(0) for n in ("uid", "key", "window")}), budget, history)
        got = sorted(made.collect(), key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.window))
        back = {r.conv_id: r for r in CF.read_back(made).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    repeats = 0
    for c in {r[0] for r in rows}:
        turns = ordered(rows, c)
        whole = [tokens(*t) for t in turns]
        system = turns[0][0] == "system" and 2 * whole[0][1] <= budget
        mine = [r for r in got if r.conv_id == c]
        assert [r.window for r in mine] == list(range(len(mine)))
        done = 0
        for r in mine:
            fresh = r.n_turns - r.n_repeated
            head = 1 if r.window and system else 0
            old = r.n_repeated - head
            span = list(range(done - old, done + fresh))
            expected = ([0] if head else []) + span
            assert old >= 0 and (not old or span[0] >= (1 if system else 0)) and fresh > 0
            assert r.text == "".join(whole[i][0] for i in expected) and r.n_tokens == sum(whole[i][1] for i in expected)
            assert sum(whole[i][1] for i in span[:old]) <= history and r.over_budget == (r.n_tokens > budget)
            assert r.n_tokens <= budget or (fresh == 1 and old == 0)
            repeats += old
            done += fresh
            if done < len(turns):
                assert r.n_tokens + whole[done][1] > budget  # the next turn does not fit
            learnt = [turns[i][1] for i in span[old:] if turns[i][0] == "assistant"]
            assert [CF.unescape(r.text[s.start : s.end]) for s in r.loss] == learnt
        assert done == len(turns)
        said = "".join(t for role, t in turns if role == "assistant")
        b = back.pop(c)
        assert (b.n_turns, b.turns_sha256) == (len(turns), sha("".join(f"{role}\n{text}\n" for role, text in turns)))
        assert (b.loss_chars, b.loss_sha256, b.formatted_chars) == (len(said), sha(said), sum(len(r.text) for r in mine))
    assert not back and repeats > 50


def test_chat_query_adds_control_strings(spark):
    empty = spark.createDataFrame([], TURNS)
    assert CF.read_back(CF.windows(empty)).count() == 0
    r = CF.read_back(CF.windows(CF.with_control_strings(empty))).first()
    assert (r.conv_id, r.n_turns, r.loss_chars, r.loss_sha256) == (-1, 2, len(SAID), sha(SAID))
    assert r.turns_sha256 == sha(f"user\n{SAID}\nassistant\n{SAID}\n")
    long = spark.createDataFrame([(1, 0, "assistant", "very " * 100_000)], TURNS)
    assert CF.read_back(CF.windows(long)).first().loss_chars == 500_000


# --- hard negatives -------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [3, 300, 1 << 20, 1 << 29, 1 << 45])
def test_packed_products_are_exact(size):
    rng = np.random.default_rng(size)
    for low, high in ((-size, size), (0, size), (-size, 0), (-size, 1 - size)):
        v, anchors = rng.integers(low, high, (50, 9)), rng.integers(-size, size, (4, 9))
        reach = max(sum(map(abs, a)) for a in anchors.tolist())
        packed = HN.Packed(v, reach)
        for a in anchors.tolist():
            exact = [sum(x * y for x, y in zip(a, row)) for row in v.tolist()]
            assert packed.scores(a).tolist() == [min(max(x, -(1 << 63)), (1 << 63) - 1) for x in exact]
    assert HN.Packed(np.zeros((3, 0), np.int64), 0).scores([]).tolist() == [0, 0, 0]


VECTORS = "vec_id long, embedding array<float>, label int"


def brute_negatives(rows):
    live = []
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v):
            live.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = []
    for a, (i, label, v) in enumerate(live):
        if i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, lab) for b, (j, lab, w) in enumerate(live) if b != a and len(w) == len(v))
        for p, j, _ in [s for s in scored if s[2] == label][:5]:
            fit = [(n, m) for n, m, lab in scored if lab != label and 80 * -p <= 100 * -n <= 100 * -p][:5]
            out += [(i, j, r + 1, m, -p, -n) for r, (n, m) in enumerate(fit)]
    return Counter(out)


@pytest.mark.parametrize("block,chunk", [(40, 8), (1 << 19, 1 << 17)])
def test_hard_negatives_equal_brute_force(spark, block, chunk):
    rng = random.Random(9)
    rows = [(i, [rng.choice([-0.5, 0.1, 0.25, 0.75, 1.5]) for _ in range(4)], rng.choice([0, 0, 0, 1, 9])) for i in range(420)]
    rows += [(100, rows[100][1], rows[100][2]), (100, rows[100][1], rows[100][2]), (11, rows[11][1], 1), (None, [0.1] * 4, 0)]
    rows += [(1000, None, 1), (1100, [0.5] * 4, None), (1200, [0.5, None, 0.1, 0.1], 1), (1300, [float("nan")] * 4, 1), (1400, [float("inf")] * 4, 1)]
    rows += [(1500, [1.0, 2.0], 3), (1501, [1.0, 1.0], 3), (1502, [1.0, 0.9], 4), (1600, [], 3), (1601, [], 3), (1603, [], 5), (2000, [0.9] * 4, 77), (-100, [0.4] * 4, 0)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({n: HN.F.lit(1) for n in ("uid", "dim", "v", "block")})
    got = Counter(tuple(r) for r in HN.mine(df, block=block, chunk=chunk).collect())
    assert got == brute_negatives(rows) and len(got) > 50
    assert HN.mine(spark.createDataFrame([], VECTORS)).count() == 0
    assert HN.mine(spark.createDataFrame([(0, [1e30, 1.0], 1), (1, [1e30, 1.0], 1), (2, [1e30, 0.5], 2)], VECTORS)).count() == 1
