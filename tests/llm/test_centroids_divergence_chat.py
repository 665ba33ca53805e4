"""Centroid clustering, source divergence and chat formatting against plain versions on small rows."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from evenkeel.llm import centroids, chat_format, divergence


def plain_clusters(rows, k, rounds, width):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    drawn = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    at = [v for _, v in drawn[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(at))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[near(v)[1]].append(v)
        at = [[sum(x) // len(members[j]) for x in zip(*members[j])] if members[j] else c for j, c in enumerate(at)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, c in found:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted([(i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, d, c in found], key=str)


SHAPE = "vec_id long, embedding array<double>, cluster int, ints int, lead int"


@pytest.mark.parametrize("leading", [1, 5, 6])
def test_clusters_equal_brute_force(spark, leading):
    draw = np.random.default_rng(4)
    rows = [(i, (draw.standard_normal(6) * [9, 3, 1, 0.2, 0.1, 0] + (i % 5)).round(2).tolist()) for i in range(300)]
    rows += [rows[7]] * 40 + [(900, None), (901, [1.0]), (902, [float("nan")] * 6), (903, [None] * 6), (904, [float("inf")] * 6), (905, [0.0] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SHAPE).repartition(5)
    got = centroids.cluster(df, centroids=9, rounds=3, dimensions=6, leading=leading)
    assert sorted(map(tuple, got.collect()), key=str) == plain_clusters(rows, 9, 3, 6)


def test_clusters_of_few_and_no_vectors(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [-1.0, 0.5])]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SHAPE)
    assert sorted(map(tuple, centroids.cluster(df, dimensions=2).collect()), key=str) == plain_clusters(rows, 40, 5, 2)
    assert centroids.cluster(df.limit(0)).count() == 0
    assert centroids.cluster(df.filter("vec_id > 5"), dimensions=2).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_a_bound_never_rules_out_the_nearest():
    draw = np.random.default_rng(8)
    for scale in (1, 1000, 1 << 20, 1 << 40):
        ints = (draw.standard_normal((500, 8)) * scale).astype(np.int64) + scale * 100
        at = ints[:20].copy()
        at[3] = at[11]  # ties go to the smaller number
        axes = centroids.Axes(ints.mean(0), np.linalg.qr(draw.standard_normal((8, 3)))[0])
        chosen, distance, _ = centroids.nearest(ints, *axes.apart(ints), at, axes.apart(at))
        whole = ((ints[:, None].astype(object) - at[None].astype(object)) ** 2).sum(2)
        assert chosen.tolist() == [min(range(20), key=lambda j: (w[j], j)) for w in whole]
        assert distance.tolist() == whole.min(1).tolist()


def test_most_centroids_are_ruled_out():
    draw = np.random.default_rng(9)
    centres = draw.standard_normal((40, 64)) * np.geomspace(300, 1, 64)
    ints = np.concatenate([c + draw.standard_normal((50, 64)) * 5 for c in centres]).astype(np.int64)
    _, directions = np.linalg.eigh(np.cov(ints.T))
    axes = centroids.Axes(ints.mean(0), directions[:, ::-1][:, :12])
    at = centres.astype(np.int64)
    _, _, measured = centroids.nearest(ints, *axes.apart(ints), at, axes.apart(at))
    assert measured < 2 * len(ints)  # of 40 each


def test_too_large_a_component_is_an_error(spark):
    df = spark.createDataFrame([(1, [1e30, 1.0], 1, 2, 3)], SHAPE)
    with pytest.raises(Exception, match="too large for integers"):
        centroids.cluster(df, dimensions=2).collect()


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 2048, 5000])
def test_perfect_hash_fills_every_slot(n):
    hashes = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
    displacement, slot = divergence.perfect_hash(hashes)
    assert sorted(slot.tolist()) == list(range(n))
    bucket = ((hashes >> np.uint64(32)) % np.uint64(max(1, n // 4))).astype(np.int64)
    move = displacement[bucket]
    assert np.where(move < 0, -1 - move, divergence.sent_to(hashes, np.maximum(move, 0), n)).tolist() == slot.tolist()


def test_foreign_terms_are_not_found():
    import pandas as pd

    listed = [f"w{i}" for i in range(3000)]
    number = divergence.shard_numbers([t.encode() for t in listed], 2)
    rows = pd.concat([divergence.build_shard(pd.DataFrame({"lang": "x", "shard": s, "term": [t for t, k in zip(listed, number) if k == s]})) for s in (0, 1)])
    lookup = divergence.Lookup(2, rows.to_dict("records"))
    asked = [t.encode() for t in listed] + [f"v{i}".encode() for i in range(5000)] + [b"", "é".encode()]
    place, shard, slot = lookup.find(asked)
    assert place.tolist() == list(range(3000)) and len({*zip(shard.tolist(), slot.tolist())}) == 3000
    assert divergence.Lookup(2, rows.to_dict("records")[:1]).find(asked)[0].tolist() == [i for i in range(3000) if number[i] == 0]


def plain_audit(rows, least, top):
    lower = {c: c + 32 for c in range(65, 91)}
    listed = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))) for text, lang, source in rows]
    held = Counter((lang, t) for lang, _, words in listed for t in set(words))
    out = []
    for lang in {x[0] for x in listed}:
        kept = sorted(t for (x, t), n in held.items() if x == lang and n >= least)
        count = defaultdict(Counter)
        for x, source, words in listed:
            if x == lang:
                count[source].update(w for w in words if w in set(kept))
        whole = sum(count.values(), Counter())

        def share(c):
            total = sum(c.values()) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // total for t in kept}

        p, q = {s: share(c) for s, c in count.items()}, share(whole)
        for s in p:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in p if o != s]
            used = [(p[s][t] - q[t], t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", used)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, o, v, i) for i, (v, o) in enumerate(ranked, 1) if part == "pair" or i <= top]
    return sorted(out)


def audited_rows():
    draw = np.random.default_rng(2)
    words = [f"W{'abcdefghij'[i % 10]}{'éüß漢zq'[i % 6]}{'xyzuv'[i % 5]}" for i in range(60)]
    rows = []
    for i in range(240):
        chosen = draw.choice(words, int(draw.integers(0, 30)), p=np.geomspace(30, 1, 60) / np.geomspace(30, 1, 60).sum())
        rows.append((" ".join(chosen) + ("! 3x_" if i % 3 else "\n"), ["en", "de", None][i % 3], f"s{i % 7}" if i % 11 else None))
    return rows + [rows[0]] * 30 + [(None, "en", "only"), ("", "lonely", "a"), ("some words", "lonely", "b"), (None, None, None)]


@pytest.mark.parametrize("setting", [(3, 50), (3, 4), (500, 50), (1, 2)])
def test_audit_equals_brute_force(spark, setting, monkeypatch):
    monkeypatch.setattr(divergence, "SHARD_TERMS", 7)
    monkeypatch.setattr(divergence, "SOURCE_BLOCK", 3)
    rows = audited_rows()
    df = spark.createDataFrame([(*r, 1, 2, 3, "t") for r in rows], "text string, lang string, source string, shard int, part int, n long, term string")
    got = divergence.audit(df.repartition(6), *setting, broadcast_bytes=100)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, *setting)


@pytest.fixture
def scattered(spark):
    """Joins shuffled and partitions kept apart, so that rows of one key come in another order for every key."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def test_audit_of_sources_in_another_order_in_every_shard(spark, scattered, monkeypatch):
    monkeypatch.setattr(divergence, "SHARD_TERMS", 7)
    rows = audited_rows()
    got = divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string").repartition(6), 3)
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, 3, 50)


def test_audit_of_nothing(spark):
    df = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(df).count() == 0


def test_tasks_hand_on_what_they_hold(spark, monkeypatch):
    rows = audited_rows()
    df = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1)
    monkeypatch.setattr(divergence, "HELD_BYTES", 300)
    monkeypatch.setattr(divergence, "HELD_BLOCKS", 2)
    assert sorted(map(tuple, divergence.audit(df, 3).collect())) == plain_audit(rows, 3, 50)


def test_shares_are_exact():
    counts = np.array([0, 1, 7, 10**12, 3 * 10**14], np.int64)
    total = int(counts.sum()) + 25
    assert divergence.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 5) // total for c in counts]
    with pytest.raises(OverflowError):
        divergence.shares(counts, 1 << 53)


EVENT = "conv_id long, seq long, message long, kind string, role string, text string, part int, base string"


def folded(spark, events):
    df = spark.createDataFrame([(*e, 1, "x") for e in events], EVENT).repartition(3)
    return sorted([tuple(r) for r in chat_format.fold(df).collect()], key=str)


def test_fold(spark):
    events = [
        (1, 1, 0, "start", "user", None), (1, 2, 0, "delta", None, "Hel"), (1, 3, 0, "delta", None, "lo"), (1, 3, 0, "delta", None, "lo"),
        (1, 4, 1, "start", "assistant", None), (1, 5, 1, "delta", None, "bad"), (1, 6, 2, "start", "user", "ignored"), (1, 7, 2, "delta", None, "why"),
        (1, 8, 1, "regenerate", None, None), (1, 9, 1, "delta", None, "good"), (1, 10, 2, "start", "tool", None), (1, 11, 2, "delta", None, "x"),
        (1, 12, 2, "edit", None, "yz"), (1, 13, 2, "delta", None, "!"), (1, 14, 3, "delta", None, None), (1, 15, 3, "unknown", "user", "no"),
        (1, None, 4, "delta", None, "no"), (1, 16, None, "delta", None, "no"), (None, 1, 0, "edit", "user", "alone"), (None, 1, 0, "delta", None, " too"),
        (2, 1, 0, "start", "user", None), (2, 2, 1, "start", "assistant", None), (2, 3, 2, "start", "user", None), (2, 4, 0, "regenerate", None, None),
    ]
    assert folded(spark, events) == sorted(
        [(1, 0, "user", "Hello"), (1, 1, "assistant", "good"), (1, 2, "tool", "yz!"), (1, 3, "", ""), (None, 0, "user", "alone too"), (2, 0, "user", "")], key=str
    )
    assert folded(spark, events[:0]) == []


MARKED = st.text(alphabet=st.sampled_from(list("<>[]/\\sINTSYROLE é\n%")), max_size=40) | st.sampled_from(
    ["</s>", "[INST] ", "[\\INST]", "<<SYS>>", "<<</SYS>>", "[ROLE x]", "[/ROLE]", "\\</s>", "<\\/s>", "<", "[", "</s", ""]
)


@given(st.lists(st.tuples(st.sampled_from(["user", "system", "assistant", "", "a]b[<%5D"]), MARKED), max_size=6))
@settings(max_examples=300, deadline=None)
def test_template_is_reversible(rows):
    """The template written plainly; the column expressions are held against it below."""
    assert list(chat_format.turns(plain_format(rows))) == rows


def plain_escape(text):
    return re.sub(chat_format.PLAIN, lambda m: m[1] + m[2] + "\\" + m[3], text)


def plain_format(rows):
    out = "<s>" if rows else ""
    for role, text in rows:
        name = role.replace("%", "%25").replace("]", "%5D").replace("[", "%5B").replace("<", "%3C")
        marks = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("", "</s>")}
        before, after = marks.get(role, (f"[ROLE {name}]", "[/ROLE]"))
        out += before + plain_escape(text) + after
    return out


def spoken(rows):
    draw = np.random.default_rng(1)
    marks = ["</s>", "[INST] ", "[\\INST]", "<<SYS>>", "<", "[/ROLE]", "\\", "ü", "ok ", "</s", "😀"]
    roles = ["user", "assistant", "system", "tool", "a]b", ""]
    return [(c, i, str(draw.choice(roles)), "".join(draw.choice(marks, int(draw.integers(0, 9))))) for c in range(rows) for i in range(int(draw.integers(1, 8)))]


def test_render_and_read_back(spark):
    rows = spoken(40) + [(100, 0, None, None), (100, 0, "assistant", "b"), (100, 0, "assistant", "b"), (None, None, "assistant", "x" * 100_000), (None, 3, "user", "</s>")]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, formatted string").repartition(4)
    parts = chat_format.render(chat_format.fold(chat_format.logged(df))).cache()
    by = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        by[c].append((role or "", text or ""))
    whole = {r["conv_id"]: r for r in chat_format.joined(parts).collect()}
    assert {c: r["formatted"] for c, r in whole.items()} == {c: plain_format(x) for c, x in by.items()}
    got = {r["conv_id"]: r for r in chat_format.read_back(parts).collect()}
    for c, turns in by.items():
        said = "".join(t for r, t in turns if r == "assistant")
        assert "".join(chat_format.unescaped(whole[c]["formatted"][s["start"] : s["end"]]) for s in whole[c]["loss"]) == said
        assert tuple(got[c]) == (
            c, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said),
            hashlib.sha256(said.encode()).hexdigest(), len(whole[c]["formatted"]),
        )
    assert chat_format.read_back(parts.limit(0)).count() == 0
    assert chat_format.logged(df.limit(0)).count() == 0


def test_a_log_holds_drafts_edits_and_branches(spark):
    df = spark.createDataFrame([(i, t, "user" if t % 2 == 0 else "assistant", "words " * 9) for i in range(30) for t in range(4)], "conv_id long, turn long, role string, text string")
    kinds = {r["kind"]: r["count"] for r in chat_format.logged(df).groupBy("kind").count().collect()}
    assert set(kinds) == {"start", "delta", "edit", "regenerate"} and kinds["start"] == 120 + kinds["regenerate"]
