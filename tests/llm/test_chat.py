"""Chat formatting against plain trees, round trips of the template, and odd threads."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from veldspar.llm import chat
from veldspar.llm import queries as Q

NODES = "tree string, id long, parent long, role string, text string, score double"


def plain_paths(rows, best=None):
    """(tree, leaf) to (rank, score, ids from the root) of trees without rings."""
    out = {}
    for tree in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == tree}
        parents = {r[2] for r in own.values()}
        found = []
        for leaf in own:
            if leaf in parents:
                continue
            path, at = [], leaf
            while at in own:
                path.append(at)
                at = own[at][2]
            found.append((-sum(own[i][5] for i in path) / len(path), f"={leaf}", leaf, path[::-1]))
        for rank, (score, _, leaf, path) in enumerate(sorted(found)[:best], 1):
            out[tree, leaf] = (rank, pytest.approx(-score), path)
    return out


@pytest.mark.parametrize("best", [None, 2])
def test_trees(spark, best):
    r = random.Random(4)
    rows = []
    for t in range(12):
        for i in range(r.randrange(1, 60)):
            parent = r.choice([None, 9999]) if i == 0 else r.randrange(max(0, i - 3), i) if t % 2 else r.randrange(i)
            rows.append((f"t{t}", i, parent, r.choice(["user", "assistant"]), f"text {i} <s> [INST]\\", float(r.randrange(5))))
    df = spark.createDataFrame(rows, NODES)
    found = chat.conversations(df, chat.replies(df, "tree", "id", "parent", "score"), "tree", "id", best=best)
    got = found.select("*", chat.turns(F.col("formatted")).alias("turns")).collect()
    want, by = plain_paths(rows, best), {(r[0], r[1]): r for r in rows}
    assert {(g.tree, g.leaf_id): (g.branch_rank, g.branch_score, [int(t.text.split()[1]) for t in g.turns]) for g in got} == want
    for g in got:
        path = want[g.tree, g.leaf_id][2]
        assert [(t.role, t.text) for t in g.turns] == [by[g.tree, i][3:5] for i in path]
        masked = [chat_plain(by[g.tree, i][4]) for i in path if by[g.tree, i][3] == "assistant"]
        assert [g.formatted[s.begin : s.end] for s in g.loss] == masked


def chat_plain(text):
    """The escape, character by character."""
    out, i = "", 0
    while i < len(text):
        out += text[i]
        if text[i] in "<[":
            j = i + 1
            while j < len(text) and text[j] == "\\":
                j += 1
            rest = text[j:]
            name = rest[1 : rest.find("|>")] if rest.startswith("|") and "|>" in rest else ""
            if rest.startswith(("s>", "/s>", "INST]", "/INST]")) or (name and name.isascii() and name.replace("_", "a").isalnum()):
                out += "\\"
        i += 1
    return out


def test_template_is_reversible(spark):
    parts = ["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "|im_end|>", "|>", "\n", "é", "|im_start|>", "|x|>", chat.SEP, chat.END]
    r = random.Random(6)
    texts = ["".join(p) for n in (1, 2, 3) for p in itertools.product(parts[:9], repeat=n)] + ["".join(r.choice(parts) for _ in range(r.randrange(20))) for _ in range(500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    got = df.select("text", chat.escape(F.col("text")).alias("e"), chat.unescape(chat.escape(F.col("text"))).alias("back")).collect()
    for g in got:
        assert g.back == g.text and g.e == chat_plain(g.text)
        assert not any(c in g.e for c in ("<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|im_sep|>"))
    messages = df.selectExpr("i div 7 as t", "i as n", "text as role", "text")
    found = chat.conversations(messages, chat.threads(messages, "t", "n"), "t", "n").select("t", chat.turns(F.col("formatted")).alias("turns")).collect()
    assert {g.t: [(t.role, t.text) for t in g.turns] for g in found} == {k: [(texts[i], texts[i]) for i in range(k * 7, min(len(texts), k * 7 + 7))] for k in range(-(-len(texts) // 7))}


def test_odd_threads(spark):
    rows = [("a", 1, 2, "user", "x", 0.0), ("a", 2, 1, "user", "y", 0.0), ("a", 3, 2, "assistant", "z", 0.0), ("b", 1, 1, "user", "own", 1.0)]
    rows += [(None, None, None, None, None, None), (None, 1, None, "assistant", None, 2.0), ("c", 1, None, "user", "twice", 1.0), ("c", 1, None, "user", "twice", 1.0), ("c", 2, 1, "assistant", "re", 1.0)]
    df = spark.createDataFrame([(*x, 7) for x in rows], NODES + ", formatted int")
    got = chat.conversations(df, chat.replies(df, "tree", "id", "parent", "score"), "tree", "id").select("tree", "leaf_id", chat.turns(F.col("formatted")).alias("t"), chat.learned(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    found = sorted((str(g.tree), str(g.leaf_id), [tuple(t) for t in g.t], g.learned) for g in got)
    assert found == [
        ("None", "1", [("assistant", "")], ""), ("None", "None", [("", "")], ""), ("a", "1", [("user", "x")], ""), ("a", "2", [("user", "y")], ""), ("a", "3", [("assistant", "z")], "z"),
        ("b", "1", [("user", "own")], ""), ("c", "2", [("user", "twice"), ("user", "twice"), ("assistant", "re")], "re"),
    ]
    none = spark.createDataFrame([], NODES)
    assert chat.conversations(none, chat.replies(none, "tree", "id", "parent"), "tree", "id").collect() == []


def test_long_thread_takes_few_rounds(spark):
    df = spark.range(3000).selectExpr("1 as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "repeat(cast(id as string), 3) as text")
    _, ups = chat._rise(chat.threads(df, "conv_id", "turn"))
    assert len(ups) == 12
    g = chat.conversations(df, chat.threads(df, "conv_id", "turn"), "conv_id", "turn").select("*", chat.learned(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    assert len(g) == 1 and g[0].learned == "".join(str(i) * 3 for i in range(1, 3000, 2))


def test_query(spark, sf):
    rows = [tuple(r) for r in Q.read(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", Q.CONTROLS), (-7, 1, "assistant", Q.CONTROLS)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.conv_id: r for r in Q.op13_chat(spark, sf).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, g in got.items():
        own = sorted(r[1:] for r in rows if r[0] == conv)
        loss = "".join(t or "" for _, role, t in own if role == "assistant")
        assert (g.n_turns, g.turns_sha256) == (len(own), sha("".join(f"{role}\n{t or ''}\n" for _, role, t in own)))
        assert (g.loss_chars, g.loss_sha256) == (len(loss), sha(loss))
        assert g.formatted_chars == sum(len(chat.START + chat.SEP + chat.END + chat_plain(role) + chat_plain(t or "")) for _, role, t in own)
