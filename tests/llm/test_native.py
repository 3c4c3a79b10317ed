"""Sharding, exact dedup, mixing, chat formatting and URL filters against brute force and in edge cases."""

import hashlib
import itertools
import math
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quantloom.llm import chat, exact_dedup, mixing, sharding, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, norm string, shard string"


def docs_of(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "clash", "clash", "clash") for i, t, s in rows], DOCS)


EDGE = [(1, None, "a"), (2, "", "a"), (3, " \n", None), (4, "x", "b"), (4, "x", "b"), (None, "X", None), (5, "word " * 20_000, "b"), (6, "É é", "c"), (7, "É É", "c")]


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# sharding


def test_shards_are_balanced_and_positions_gapless(spark, docs):
    rows = sharding.shard(docs, 16).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(sizes) == set(range(16))
    assert max(sizes.values()) - min(sizes.values()) <= max(r.size for r in rows)


def test_rebalance_moves_only_to_new_shards(spark, docs):
    m = sharding.build_slot_map(sharding.slot_sizes(sharding.records(docs)), 4)
    old, new = {r.virtual_slot: r for r in m.collect()}, {r.virtual_slot: r for r in sharding.rebalance(m, 5).collect()}
    moved = [s for s in old if old[s].shard != new[s].shard]
    assert moved and all(new[s].shard == 4 for s in moved) and {r.version for r in new.values()} == {2}
    total = sum(r.bytes for r in old.values())
    assert abs(sum(new[s].bytes for s in moved) - total / 5) < total / 10


def test_stored_map_versions(spark, docs, tmp_path):
    m = sharding.build_slot_map(sharding.slot_sizes(sharding.records(docs)), 4)
    sharding.save_slot_map(m, str(tmp_path / "map"))
    sharding.save_slot_map(sharding.rebalance(m, 5), str(tmp_path / "map"))
    assert sharding.load_slot_map(spark, str(tmp_path / "map")).agg(F.max("shard")).first()[0] == 4
    first = sharding.load_slot_map(spark, str(tmp_path / "map"), 1)
    assert first.agg(F.max("shard")).first()[0] == 3
    again = sharding.shard(docs, slot_map=first)
    assert again.count() == docs.count()


def test_stored_map_takes_other_records(spark, docs):
    m = sharding.build_slot_map(sharding.slot_sizes(sharding.records(docs)), 4)
    assert {r.virtual_slot for r in m.collect()} == set(range(sharding.N_SLOTS))
    other = docs.withColumn("doc_id", F.col("doc_id") + 10**9)
    sparse = m.filter("bytes > 0")
    for stored in (m, sparse):
        rows = sharding.shard(other, slot_map=stored).collect()
        assert len(rows) == other.count() and {r.shard for r in rows} == set(range(4))
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_copies_of_one_row_fill_slots_in_turn(spark, docs):
    hot = docs.limit(1).select("doc_id", "text").crossJoin(spark.range(2000).select(F.col("id").alias("k"))).drop("k").repartition(5)
    both = docs.select("doc_id", "text").unionByName(hot)
    rows = sharding.shard(both, 16).collect()
    assert len(rows) == both.count()
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert max(sizes.values()) - min(sizes.values()) <= max(r.size for r in rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.shard(both.repartition(3), 16).collect()
    assert sorted((r.doc_id, r.virtual_slot) for r in rows) == sorted((r.doc_id, r.virtual_slot) for r in again)


def test_sharding_edges(spark):
    df = docs_of(spark, EDGE)
    rows = sharding.shard(df, 3).collect()
    assert len(rows) == len(EDGE) and {r.size for r in rows if r.doc_id in (1, 2)} == {1}
    assert sharding.shard(df.limit(0), 3).count() == 0


# exact dedup


def test_exact_dedup_edges(spark):
    df = docs_of(spark, EDGE)
    got = exact_dedup.exact_dedup(df, salts=3).collect()
    groups = defaultdict(list)
    for i, t, _ in EDGE:
        groups[lower(t)].append(i)
    assert len(got) == len(EDGE)
    for r in got:
        members = next(m for t, m in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256 and (r.doc_id in m))
        keep = max((x for x in members if x is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(members), r.doc_id == keep)
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0
    kept = exact_dedup.keep_distinct(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 4, 5, 6, 7]


def test_hot_group(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Same Text").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.exact_dedup(df).filter("group_size > 1").agg(F.count("*"), F.min("keep_id"), F.max("keep_id"), F.max("group_size")).first()
    assert tuple(got) == (1000, 2997, 2997, 1000)


# mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, epochs=2):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > epochs * sizes[s]}
        if not over:
            target |= {s: level * w[s] for s in free}
            break
        for s in over:
            target[s] = epochs * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("bucket_rows", [40, 50_000])
def test_mix_matches_budget(spark, docs, bucket_rows):
    rows = mixing.mix(docs, bucket_rows=bucket_rows).collect()
    size, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        size[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size and r.source_size == next(x.source_size for x in rows if x.source == r.source)
    want = brute_targets(size)
    for s in size:
        assert math.isclose(want[s], next(r.target for r in rows if r.source == s), rel_tol=1e-9, abs_tol=1e-9)
        assert taken[s] == math.floor(want[s] + 1e-9) or abs(taken[s] - want[s]) <= 1
    again = mixing.mix(docs.repartition(7), bucket_rows=77).collect()
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in again}


def test_copies_of_one_row_are_spread_over_buckets(spark, docs):
    hot = spark.range(3000).selectExpr("7L AS doc_id", "'one two three' AS text", "'a' AS source").repartition(5)
    sized = mixing.sized(hot)
    assert sized.select("key").distinct().count() == 3000
    rows = mixing.mix(hot, bucket_rows=100).collect()
    assert len(rows) == 3000 and sum(r.taken for r in rows) == math.floor(1.5 * 9000) and max(r.taken for r in rows) <= 6


def test_mix_edges_and_effect(spark):
    df = docs_of(spark, EDGE)
    rows = mixing.mix(df).collect()
    assert len(rows) == len(EDGE) and all(r.taken == 0 for r in rows if r.size == 0)
    assert mixing.mix(df.limit(0)).count() == 0
    clean = df.dropDuplicates(["doc_id"])
    taken = {r.doc_id: r.taken for r in mixing.mix(clean).collect()}
    out = mixing.apply_mix(clean)
    assert out.columns == df.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
    assert words == {i: n for i, n in taken.items() if n}


@pytest.mark.parametrize("ids", [[None] * 60, [7] * 60, [None, 7] * 30])
def test_mixed_rows_keep_their_own_decision(spark, ids):
    rows = [(x, " ".join(f"s{i}w{k}" for k in range(5 + i)), "en", "ab"[i % 3 == 0], 0) for i, x in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want, got = defaultdict(list), defaultdict(lambda: defaultdict(int))
    for r in mixing.mix(df).collect():
        want[r.source].append(r.taken)
    for r in mixing.apply_mix(df).collect():
        words = r.text.split()
        got[r.source][words[0]] += len(words)
        assert words == [f"{words[0][:-2]}w{k}" for k in range(len(words))]
    for s, taken in want.items():
        assert sum(got[s].values()) == sum(taken) and len(got[s]) == sum(t > 0 for t in taken)


# chat


HARD = ["</s>[INST] ok [/INST]", "a\\eb", "\\l\\b", "<s>", "plain", "", None, "[INST", "x </s", "<", "\\", "ünï 🙂 </s>", "line\n\n[/INST]\n"]


def test_round_trip(spark):
    rows = [(c, t, role, text, "clash") for c in range(3) for t, (role, text) in enumerate((r, x) for r in ("user", "assistant", None, "a [/INST] b") for x in HARD)]
    rows += [(9, None, "assistant", "only", "clash"), (None, 0, "user", "no id", "clash"), (10, 0, "user", "w " * 50_000, "clash")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_chat(df)
    got = {r.conv_id: r for r in out.withColumn("turns", chat.parse(F.col("formatted"))).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == c)
        r = got[c]
        assert [(t.role, t.text) for t in r.turns] == [(role, text) for _, role, text in turns]
        spans = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        undo = [s.replace("\\l", "<").replace("\\b", "[").replace("\\e", "\\") for s in spans]
        assert undo == [text for _, role, text in turns if role == "assistant"] or any("\\" in t for _, _, t in turns)
        body = "".join(t for _, role, t in turns if role == "assistant")
        d = chat.digests(out.filter(F.col("conv_id").eqNullSafe(F.lit(c)))).first()
        assert d.loss_sha256 == hashlib.sha256(body.encode()).hexdigest() and d.loss_chars == len(body) and d.n_turns == len(turns)
        assert r.formatted.count("</s>") == len(turns) and r.formatted.count("[INST]") == len(turns)
    assert chat.format_chat(df.limit(0)).count() == 0


# URL filters


def brute_url(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    host = rest
    for i, ch in enumerate(rest):
        if ch in "/?#":
            host = rest[:i]
            break
    tail = rest[len(host) :]
    path = tail
    for i, ch in enumerate(tail):
        if ch in "?#":
            path = tail[:i]
            break
    return lower(host), path


URLS = [
    None, "", "no scheme", "http://example.com/en/7x?y#z", "https://EXAMPLE.com/en/8", "x://a.b.example.com/en/70", "http://com/en/", "http://com/en", "http://notcom/en/1", "http://a.net/de/8",
    "http://example.net/de/88", "http://m.example.net/de/9", "http://org?x=/es/", "http://x.org/es/1?q=1&q=2", "http://x.org#/es/", "://host/p", "http://h" + "a." * 500 + "org/es/", "http://a://b/c",
]


def test_explicit_rules(spark):
    df = spark.createDataFrame([(i, u, "h", "clash") for i, u in enumerate(URLS)], "page_id long, url string, html string, tokens string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_filter.judge(df, labels).collect()}
    for i, u in enumerate(URLS):
        host, path = brute_url(u)
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict)
    assert url_filter.judge(df.limit(0), labels).count() == 0


def test_mined_rules_match_brute_force(spark):
    rows = [(i, f"http://{'bad' if i % 5 == 0 else 'good'}{i % 3}.test.org/{'casino' if i % 5 == 0 and i % 2 else 'news'}/{i}") for i in range(600)]
    labels = [(i, 0 if i % 5 == 0 and i % 2 else 1, 0) for i in range(0, 600)]
    pages = spark.createDataFrame(rows + rows[:1], "page_id long, url string")
    got = url_filter.judge(pages, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 601
    assert {r.page_id for r in got if r.verdict == "block"} == {i for i, q, _ in labels if q == 0}
    host, path = url_filter.host_and_path(F.col("url"))
    toks = {r.page_id: set(r.t) for r in pages.select("page_id", url_filter.tokens(F.col("url"), host, path).alias("t")).collect()}
    for r in got:
        if r.mined_rule:
            fit = [i for i in range(600) if set(r.mined_rule) <= toks[i]]
            right = sum(1 for i in fit if (labels[i][1] == 0) == (r.verdict == "block"))
            assert r.page_id in fit and math.isclose(right / len(fit), r.mined_confidence) and right >= url_filter.MIN_COUNT
            share = sum((q == 0) == (r.verdict == "block") for _, q, _ in labels) / 600
            assert r.mined_confidence >= 0.75 and r.mined_confidence / share >= 1.05 - 1e-9
    assert {r.verdict for r in got if r.mined_rule} == {"block", "allow"}


def test_rules_decide_given_pages(spark, sf_dir):
    """The full set of rules, mined once more by counting, and the best that fits each page."""
    pages, labels = spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    host, path = url_filter.host_and_path(F.col("url"))
    toks = {r.page_id: frozenset(r.t) for r in pages.select("page_id", url_filter.tokens(F.col("url"), host, path).alias("t")).collect()}
    bad = {r.doc_id: r.quality == 0 for r in labels.collect()}
    known = [i for i in toks if i in bad]
    base = {True: sum(bad[i] for i in known) / len(known), False: sum(not bad[i] for i in known) / len(known)}
    counts = defaultdict(lambda: [0, 0])
    for i in known:
        for k in range(1, len(toks[i]) + 1):
            for c in itertools.combinations(sorted(toks[i]), k):
                counts[c][bad[i]] += 1
    least = max(0.01 * len(known), 20)
    rules = {(c, b): n[b] / sum(n) / base[b] for c, n in counts.items() for b in (False, True) if n[b] >= least and n[b] / sum(n) >= 0.75 and n[b] / sum(n) / base[b] >= 1.05}
    got = url_filter.judge(pages, labels).collect()
    for r in got:
        fit = [v for (c, _), v in rules.items() if set(c) <= toks[r.page_id]]
        assert (r.mined_rule is not None) == bool(fit)
        if fit:
            assert math.isclose(rules[tuple(sorted(r.mined_rule)), r.verdict == "block"] if r.rule is None else max(fit), max(fit))


