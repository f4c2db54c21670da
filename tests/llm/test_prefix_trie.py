import hashlib
import random
import zlib

from broadloom.llm import prefix_trie as P
from broadloom.llm.queries import TEXT_QUERIES
from check import compare, views


def rem(c):
    return c % 5 if c >= 0 else -(-c % 5)


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            own.setdefault(c, []).append((turn is not None, turn or 0, key, (role, text)))
    own = {c: [t[3] for t in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        seqs[c] = tuple(own.get(c - rem(c), [])[:h] + own[c][h:])
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    out = []
    for k, members in nodes.items():
        below = [u for u in nodes if u[:len(k)] == k]
        childless = [u for u in below if not any(len(w) == len(u) + 1 and w[:len(u)] == u for w in nodes)]
        ends = ",".join(str(c) for c in sorted(members) if len(seqs[c]) == len(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), sum(len(w) == len(k) + 1 for w in below), len(childless),
                    sum((len(nodes[u]) - 1) * len(u[-1][1].encode()) for u in below if u), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def sample(n, seed):
    r = random.Random(seed)
    rows = []
    for c in range(-12, n):
        if r.random() < 0.1:
            continue  # families without their first
        for t in range(r.choice([0, 1, 2, 3, 5, 12])):
            rows.append((c, t, r.choice(["user", None, "assistant"]), r.choice(["Hé", "", None, "b c", "d"])))
    rows += [(3, None, "user", "first"), (4, 1, "user", "tie"), (4, 1, "assistant", "tie"), (4, 1, "user", "tie"), (None, 0, "user", "nobody")]
    rows += [(c, t, "system", "all the same") for c in range(1000, 1060) for t in range(4)]
    return rows


def got(df):
    return sorted((tuple(r) for r in P.prefix_trie(df).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def test_equals_plain_trie_in_one_shard_and_in_many(spark):
    rows = sample(60, 1)
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "conv_id bigint, turn bigint, role string, text string, depth int, path string").repartition(3)
    want = plain(rows)
    assert got(df) == want
    assert got(df.coalesce(1)) == want


def test_shards_within_a_task(spark, monkeypatch):
    rows = sample(40, 2)
    want = plain(rows)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for conversations in (1, 3, 10):
        monkeypatch.setattr(P, "SHARD_CONVERSATIONS", conversations)
        assert got(df) == want


def test_long_conversation_shared_by_shards(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD_CONVERSATIONS", 1)
    rows = [(c, t, "user", f"turn {t}") for c in (0, 5, 10, 15) for t in range(40)] + [(15, 40, "user", "more")]
    assert got(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")) == plain(rows)


def test_no_conversations(spark):
    assert got(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")) == []
    assert got(spark.createDataFrame([(None, 1, "a", "b")], "conv_id bigint, turn bigint, role string, text string")) == []


def test_query_equals_sql(spark, sf):
    q = TEXT_QUERIES["op13_prefix_trie"]
    assert compare(q.build(spark, sf), views(sf), q.sql) is None
