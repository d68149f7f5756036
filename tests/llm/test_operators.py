"""Each operator against a brute-force version, and on the awkward cases that its docstring defines."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("tessera.llm")
xxhash = pytest.importorskip("xxhash")

from tessera.llm import chat, common, embeddings, html, media, mixing, pieces, quality, sharding, simhash, suffix  # noqa: E402

AWKWARD = [(1, "same text here"), (1, "same text here"), (2, None), (3, ""), (None, "no id"), (4, "x" * 300), (5, " \n\t "), (6, "é漢😀\x00")]


@pytest.fixture(scope="module")
def awkward(spark):
    common.prepare(spark)
    rows = [(i, t, "clash", "clash", 0.0) for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, row string, fp double")


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.lower())
    if not words:
        return 0
    shingles = [b" ".join(p) for p in zip(words, words[1:])] or words
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if sum(x >> i & 1 for x in h) * 2 > len(h))


def components(n, linked):
    label = list(range(n))
    while True:
        new = [min([label[i]] + [label[j] for j in range(n) if linked[i][j]]) for i in range(n)]
        if new == label:
            return label
        label = new


def test_simhash_against_all_pairs(spark, sf):
    common.prepare(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    fp = np.array([brute_fingerprint((r.text or "").encode()) for r in rows], np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 6
    label = components(len(rows), near)
    got = {r.id: r for r in simhash.near_duplicates(docs).collect()}
    for i, r in enumerate(rows):
        least = min(rows[j].doc_id for j in range(len(rows)) if label[j] == label[i])
        assert (got[r.doc_id].fp & (2**64 - 1), got[r.doc_id].n_near, got[r.doc_id].component_id) == (int(fp[i]), int(near[i].sum()) - 1, least)


def test_simhash_kernel_with_split_lists(monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT", 8)
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    fp = np.unique(np.concatenate([b ^ np.bitwise_or.reduce([np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64) for _ in range(4)]) for b in base]))
    import pyarrow as pa

    blocks = simhash.layout(len(fp), 6)
    from itertools import combinations

    rows = []
    for t, c in enumerate(combinations(range(8), 2)):
        for f in fp.tolist():
            key = sum(((f >> blocks[b][0]) & ((1 << blocks[b][1]) - 1)) << (k * 10) for k, b in enumerate(c))
            rows.append((t, key, f))
    rows.sort()
    t, k, f = (np.array(x, np.uint64) for x in zip(*rows))
    batch = pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(k.astype(np.int64)), pa.array(f.astype(np.uint64).view(np.int64)), pa.array(np.ones(len(f), np.int64))], names=["t", "key", "fp", "n"])
    near = {}
    for out in simhash._verify(iter([batch]), blocks, 6):
        for x, n in zip(out.column(0).to_numpy().view(np.uint64).tolist(), out.column(1).to_pylist()):
            near[x] = near.get(x, 0) + n
    exact = (np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 6).sum(1) - 1
    assert [near.get(x, 0) for x in fp.tolist()] == exact.tolist()


def test_simhash_awkward(awkward, empty):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == len(AWKWARD) and simhash.near_duplicates(empty).count() == 0
    blank = [r for r in rows if r.fp == 0 and r.id in (2, 3, 5)]
    assert len(blank) == 3 and {r.component_id for r in blank} == {2} and all(r.n_near >= 2 for r in blank)
    kept = simhash.deduplicate(awkward)
    assert kept.columns == awkward.columns and {1, 2, None} <= {r.doc_id for r in kept.collect()}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 101), (None, 5)], "a long, b long")
    got = {r.v: r.m for r in common.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert common.connected_components(edges.limit(0)).count() == 0


def brute_repeats(docs, length):
    seen, out = set(), {}
    for i, b in sorted(docs):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(b[p : p + length])
        runs = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g))
    return out


@pytest.mark.parametrize("length,crowd,hot", [(16, 4096, 0.001), (20, 2, 0.001), (33, 4096, 0.0)])
def test_repeats_against_a_set_of_windows(spark, monkeypatch, length, crowd, hot):
    common.prepare(spark)
    monkeypatch.setattr(suffix, "CROWD", crowd)
    rng = random.Random(length)
    base = ["".join(rng.choice("abcé ") for _ in range(rng.choice([30, 100, 200]))) for _ in range(8)]
    docs = []
    for i in range(60):
        parts = [rng.choice(base)[rng.randrange(20) :][: rng.randrange(10, 150)] if rng.random() < 0.6 else "".join(rng.choice("abcdefg é") for _ in range(rng.randrange(50))) for _ in range(rng.randrange(5))]
        docs.append((i, "ab " * rng.randrange(50) if rng.random() < 0.15 else "".join(parts)))
    kept, _ = suffix.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), length=length)
    got = {r.key: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), bytes(r.kept)) for r in kept.collect()}
    assert got == brute_repeats([(i, t.encode()) for i, t in docs], length)


def test_suffix_boundaries_are_common_prefixes():
    rng = np.random.default_rng(1)
    sym = np.concatenate([np.concatenate([rng.integers(1, 4, 40), [0]]) for _ in range(5)] * 2).astype(np.int16)
    order = suffix.suffix_order(sym, 12)
    mark = suffix.boundaries(sym, order, 12)
    text = sym.tolist()
    for i in range(1, len(sym)):
        a, b = (text[order[k] : order[k] + 12] for k in (i - 1, i))
        if 0 not in a and 0 not in b and len(a) == len(b) == 12:
            assert mark[i] == (a != b)


def test_repeats_awkward(awkward, empty):
    kept = suffix.without_repeats(awkward, length=16)
    assert kept.columns == awkward.columns
    texts = sorted((r.doc_id or 0, r.text) for r in kept.collect())
    assert texts == sorted([(0, "no id"), (1, "same text here"), (1, "same text here"), (2, ""), (3, ""), (4, "x"), (5, " \n\t "), (6, "é漢😀\x00")])
    assert suffix.without_repeats(empty).count() == 0
    with pytest.raises(ValueError):
        suffix.remove_repeats(awkward, length=5)


def test_mixing_stays_within_a_block():
    for weights in ([0.2, 0.8], [5, 3, 1, 1], [1] * 7, [0.97, 0.01, 0.02]):
        q = mixing.integer_weights(weights, 128)
        place = mixing.schedule(q, 128)
        assert sorted(np.concatenate(place).tolist()) == list(range(128))
        for n, p in zip(q, place):
            served = np.array([np.searchsorted(p, t) for t in range(129)])
            assert np.abs(served - np.arange(129) * n / 128).max() < 1
    with pytest.raises(ValueError):
        mixing.integer_weights([1, 0])


def test_mixing_stays_within_a_block_of_the_targets():
    sizes = [5_000_000] + [80_000 + 200 * i for i in range(19)]  # rows; square roots aren't multiples of any period
    for blocks, weights in (([n // 16 for n in sizes], [n**0.5 for n in sizes]), ([10**6, 10**6, 40], [1, 0.6180339887, 1e-5])):
        place = mixing.epochs(blocks, weights)
        assert np.array_equal(np.sort(np.concatenate(place)), np.arange(sum(blocks)))
        end = min(int(p[-1]) for p in place) + 1  # until the first source runs out
        for w, p in zip(weights, place):
            target = np.arange(end + 1) * (w / sum(weights))
            assert np.abs(np.searchsorted(p, np.arange(end + 1)) - target).max() < 1


def brute_schedule(blocks, weights):
    """(source, block) slot after slot, by looking at every source in every slot."""
    done, base, start, out = [0] * len(blocks), [0] * len(blocks), 0, []
    while (live := [i for i in range(len(blocks)) if done[i] < blocks[i]]):
        total, t = sum(weights[i] for i in live), len(out) - start
        i = min((-(-(done[i] - base[i] + 1) * total // weights[i]), i) for i in live if (done[i] - base[i]) * total // weights[i] <= t)[1]
        out.append((i, done[i]))
        done[i] += 1
        if done[i] == blocks[i]:
            start, base = len(out), list(done)
    return out


def test_mixing_against_every_source_in_every_slot():
    rng = random.Random(2)
    for _ in range(30):
        n = rng.randrange(1, 8)
        blocks, weights = [rng.randrange(0, 40) for _ in range(n)], [rng.randrange(1, 9) for _ in range(n)]
        want = [[slot for slot, (i, _) in enumerate(brute_schedule(blocks, weights)) if i == k] for k in range(n)]
        assert [p.tolist() for p in mixing.epochs(blocks, weights)] == want


def test_mixing_refuses_more_blocks_than_fit(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCKS", 3)
    df = spark.createDataFrame([(i, "a") for i in range(40)], "doc_id long, source string")
    with pytest.raises(ValueError):
        mixing.mix(df, block_rows=10)
    assert mixing.mix(df, block_rows=20).count() == 40


def test_mixing_places_every_row(spark, awkward, empty):
    rows = [(i, "abc"[i % 3] if i % 7 else None, "t") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, source string, Block string")
    out = mixing.mix(df, {"a": 0.6, "b": 0.3}, block_rows=4).collect()
    assert all(r.Block_0 == "t" for r in out)
    assert sorted(r.doc_id for r in out) == list(range(700)) and len({r.position for r in out}) == 700
    slots = {}
    for r in out:
        slots.setdefault(r.slot, set()).add((r.source, r.block))
    assert sorted(slots) == list(range(len(slots))) and all(len(x) == 1 for x in slots.values())
    same = mixing.mix(awkward.withColumnRenamed("row", "source"), text_col="text")
    assert same.count() == len(AWKWARD) and mixing.mix(empty, source_col="row").count() == 0


def test_chat_folds_events(spark):
    schema = "conv_id long, message long, seq long, kind string, role string, text string"
    log = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", None), (1, 1, 2, "delta", None, "a"), (1, 1, 3, "delta", None, "b"), (1, 2, 4, "message", "user", "later"),
        (1, 1, 5, "regenerate", None, None), (1, 1, 6, "delta", None, "c"), (1, 0, 7, "edit", None, "ho"), (1, 3, 8, "message", "we:ird\\", "x </turn>\n### y <\\/turn>\\"), (1, 4, 9, "what", "u", "?"),
    ]
    rendered = chat.render(chat.fold(spark.createDataFrame(log, schema))).orderBy("message").collect()
    assert [(r.role, r.text) for r in rendered] == [("user", "ho"), ("assistant", "c"), ("we:ird\\", "x </turn>\n### y <\\/turn>\\")]
    assert chat.parse("".join(r.formatted for r in rendered)) == [(r.role, r.text) for r in rendered]
    assert rendered[1].formatted[rendered[1].loss_start : rendered[1].loss_end] == "c"
    with pytest.raises(ValueError):
        chat.parse("### User: no end")


def test_chat_regenerations_end_later_messages_in_any_range(spark):
    rng = random.Random(7)
    log = []
    for conv in [None, *range(4)]:
        for m in range(60 if conv == 1 else 6):
            log.append((conv, m, m * 10, "message", "user", f"{conv}.{m}"))
            if rng.random() < 0.2:
                log.append((conv, m, rng.randrange(m * 10 + 1, 700), "regenerate", None, None))
    got = {(r.conv_id, r.message): r.text for r in chat.fold(spark.createDataFrame(log, "conv_id long, message long, seq long, kind string, role string, text string")).collect()}
    again = {}
    for c, m, q, kind, *_ in log:
        if kind == "regenerate":
            again[c, m] = max(q, again.get((c, m), -1))
    want = {}
    for c, m, q, kind, _, text in log:
        if kind == "message" and not any(d == c and e < m and a >= q for (d, e), a in again.items()):
            want[c, m] = "" if (c, m) in again else text
    assert got == want


def test_chat_awkward(spark, empty):
    schema = "conv_id long, message long, seq long, kind string, role string, text string, formatted string, n_turns int"
    long = "a\\ </turn> ### " * 20_000
    rows = [(None, 0, 0, "message", None, None, "f", 1), (1, 0, 0, "message", "user", long, "f", 1), (1, 0, 0, "message", "user", long, "f", 1), (1, 1, 1, None, "user", "x", "f", 1)]
    log = spark.createDataFrame(rows, schema)
    got = {r.conv_id: r for r in chat.conversations(chat.render(chat.fold(log))).collect()}
    assert set(got) == {None, 1} and got[None].n_turns == 1 and got[1].turns_sha256 == hashlib.sha256(f"user\n{long}\n".encode()).hexdigest()
    assert chat.conversations(chat.render(chat.fold(log.limit(0)))).count() == 0


def test_chat_reads_back_every_conversation(spark, sf):
    got = {r.conv_id: r for r in chat.op2_chat(spark, sf).collect()}
    tricky = r"\### Assistant: </turn> ok"
    turns = {-7: [("user", tricky), ("assistant", tricky)]}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    assert set(got) == set(turns)
    for c, t in turns.items():
        masked = "".join(x for role, x in t if role == "assistant")
        assert got[c].n_turns == len(t) and got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(masked), hashlib.sha256(masked.encode()).hexdigest())


@pytest.fixture(scope="module")
def model():
    return pieces.Model.load(pieces.MODEL)


def brute_path(model, word):
    words = {p: i for p, i in ((model.bytes_of[i].replace(b" ", pieces.MARK), i) for i in range(len(model.bytes_of))) if p and i not in set(model.byte)}
    s = word.replace(b" ", pieces.MARK).decode()
    best = [(0.0, [])] + [(float("-inf"), None)] * len(s)
    for j in range(1, len(s) + 1):
        for i in range(max(0, j - 16), j):
            if best[i][1] is None:
                continue
            p = words.get(s[i:j].encode())
            if p is not None:
                new = (best[i][0] + model.score[p], best[i][1] + [p])
            elif j == i + 1:
                new = (best[i][0] + model.unknown, best[i][1] + [model.byte[b] for b in s[i].encode()])
            else:
                continue
            if new[0] > best[j][0]:
                best[j] = new
    return best[-1][1]


def test_pieces_take_the_best_path(model):
    rng = random.Random(3)
    words = [b" " + "".join(rng.choice("the aé漢in\x00") for _ in range(rng.choice([1, 5, 12, 90]))).encode() for _ in range(80)]
    for w, ids in zip(words, model.words(words)):
        assert np.frombuffer(ids, np.int32).tolist() == brute_path(model, w)
    whole = b"two words, and  more"
    assert np.frombuffer(model.encode([whole])[0], np.int32).tolist() == brute_path(model, b" " + whole)


def test_pieces_round_trip(spark, model, awkward, empty):
    texts = ["", " ", "  a", "\n\n a  b▁c ▁▁ 漢字😀\x00x", "a" * 500, "▁", "é" * 100 + " " * 40, "tab\tand\r\n"]
    assert [model.decode(np.frombuffer(x, np.int32)).decode() for x in model.encode([t.encode() for t in texts])] == texts
    rows = pieces.encode(awkward).collect()
    assert len(rows) == len(AWKWARD) and all(r.exact for r in rows) and pieces.encode(empty).count() == 0
    assert sorted(r.text for r in pieces.decode(pieces.encode(awkward)).collect()) == sorted(t or "" for _, t in AWKWARD)


def test_sharding_table():
    names = [f"s{i}" for i in range(13)]
    t = sharding.table(names, 1009)
    sizes = np.bincount(t, minlength=13)
    assert sizes.max() - sizes.min() <= 1
    fewer = sharding.table(names[:-1], 1009)
    stayed = t != 12
    assert (t[stayed] != fewer[stayed]).mean() < 0.12
    heavy = np.bincount(sharding.table(names, 1009, [2] + [1] * 12), minlength=13)
    assert abs(heavy[0] - 2 * heavy[1]) <= 2
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8)):
        with pytest.raises(ValueError):
            sharding.table(*bad)


def brute_table(shards, slots, turns):
    owner, at = [None] * slots, {}
    order = {}
    for s in shards:
        d = hashlib.sha256(s.encode()).digest()
        offset, skip = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:16], "big") % (slots - 1) + 1
        order[s] = [(offset + k * skip) % slots for k in range(slots)]
    while None in owner:
        for s, n in zip(shards, turns):
            for _ in range(n):
                if None in owner:
                    at = next(x for x in order[s] if owner[x] is None)
                    owner[at] = s
    return owner


def test_sharding_places_rows_by_the_definition(spark):
    names = ["a", "b", "c", "d"]
    for turns in ([1, 1, 1, 1], [3, 1, 2, 1]):
        assert [names[i] for i in sharding.table(names, 101, turns)] == brute_table(names, 101, turns)
    rows = [(i, "s", "t", "u") for i in [*range(50), None, None]]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, Slot string, shard string, shard_0 string"), names, slots=101)
    assert got.columns == ["doc_id", "Slot_0", "shard_1", "shard_0", "slot", "shard"]
    owner = brute_table(names, 101, [1] * 4)
    for r in got.collect():
        slot = int(hashlib.md5(b"" if r.doc_id is None else f"={r.doc_id}".encode()).hexdigest()[:15], 16) % 101
        assert (r.slot, r.shard, r.Slot_0, r.shard_1, r.shard_0) == (slot, owner[slot], "s", "t", "u")
    by_slot = sharding.assign(got, names, "shard_1", 101)
    assert by_slot.count() == 52


def test_sharding_assigns_equal_keys_alike(awkward, empty):
    out = sharding.assign(awkward, ["a", "b", "c"], "doc_id", 101).collect()
    assert len(out) == len(AWKWARD) and len({r.shard for r in out if r.doc_id == 1}) == 1
    assert sharding.assign(empty, ["a"], "doc_id", 101).count() == 0


def test_media_round_trip(awkward, empty):
    rows = media.media(awkward).collect()
    texts = sorted((t or "").encode() for _, t in AWKWARD)
    assert sorted(media.load(bytes(r.media)) for r in rows) == sorted(map(media.pad, texts))
    for r in rows:
        payload = media.load(bytes(r.media))
        assert (r.payload_sha256, r.tail_crc32, r.media_bytes) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(r.media))
    assert len({r.feature for r in rows if r.id == 1}) == 1 and media.media(empty).count() == 0


def test_fingerprints_move_with_time():
    rng = np.random.default_rng(0)
    noise = rng.integers(0, 256, media.FRAME * 8, dtype=np.uint8).tobytes()
    a, b = media.fingerprint(noise), media.fingerprint(b"\x80" * media.FRAME * 3 + noise)
    assert len(a) and set((a + (3 << 32)).tolist()) <= set(b.tolist()) and (np.sort(b) == b).all()
    assert not len(media.fingerprint(b"\x80" * 4096))


PAGES = [
    ("", ""),
    ("plain & simple", "plain & simple"),
    ("<p>a<p>b <i>c</i>d<br>e", "a\nb cd\ne"),
    ('<body><div class="sidebar">no</div><header>H</header><div id="content"><h1>T</h1><p>x&nbsp;y &lt;</p><div class="comments"><p>c</p></div><form><p>f</p></form></div></body>', "T\nx y <"),
    ("<article><p>a <!-- open", "a"),
    ('<nav>m</nav><div class=ad>x</div><p>k<span class="share">s</span>l</p><script>', "kl"),
    ("<article><h1>T</h1><p>1</p><aside>n</aside><p>2  \n 3</p></article><footer>f</footer>", "T\n1\n2 3"),
    ("<p>unclosed <b>bold</p></div><p>next", "unclosed bold\nnext"),
]


def test_html_pages(spark):
    rows = [(i, f"http://h.example/{i}", h) for i, (h, _) in enumerate(PAGES)] + [(99, None, None)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: t for i, (_, t) in enumerate(PAGES)} | {99: ""}
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_self_closed_svg_ends_at_once():
    got = lambda source: html.Page(source).main()
    assert got('<p>a<svg class="i"/>b</p><p>rest</p>') == got('<p>a<svg class="i"></svg>b</p><p>rest</p>') == "a\nb\nrest"
    assert got("<article><p>a</p><SVG viewBox='0 0 > 1' /><p>b</p><svg><path d=''/>no</svg><p>c</p></article>") == "a\nb\nc"
    assert got("<p>a</p><svg class=i/>no</svg><p>b</p>") == got('<p>a</p><svg><svg class="i"/>no</svg><p>b</p>') == "a\nb"
    for tag in ("script", "textarea", "iframe"):
        assert got(f'<p>a</p><{tag} class="i"/>no</{tag}><p>b</p>') == "a\nb"


LAYOUTS = [
    '<body class="right-sidebar"><article><p>x</p></article></body>',
    '<html class="js-comments"><body class="single comments-open sticky-header"><p>x</p></body></html>',
    '<div class="content-with-sidebar"><p>x</p></div>',
    '<article class="post social"><p>x</p></article>',
    '<main id="newsletter"><p>x</p></main>',
    '<div class="sidebar"><div class="menu"><main><p>x</p></main></div><div class="menu">no</div><p>no</p></div>',
    '<div class="layout sidebar"><article class="post social"><p>x</p><div class="comments"><article class="comment"><p>no</p></article></div></article><div class="site-footer">no</div></div>',
    '<article><p>x</p></article><div class="related-posts"><article><p>no</p></article></div>',
    '<div id="content"><p>x</p><div class="share-buttons">no</div></div><div id="comments"><article class="comment-body"><p>no</p></article></div>',
    '<aside><article><p>no</p></article></aside><article><p>x</p><div class="widget">no</div></article>',
]


def test_html_layout_names_keep_the_article():
    for source in LAYOUTS:
        assert html.Page(source).main() == "x", source


def test_html_wrapper_finds_constants(spark):
    page = "<div><span>Site</span><p>Daily Site</p><ul>{}</ul><p>{}</p></div>"
    rows = [(i, "http://a.example/x", page.format("<li>x</li>" * (i + 1), f"story {i}")) for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    packed = html.infer(df).collect()
    assert len(packed) == 1
    import json

    wrapper = html.Node.unpack(json.loads(packed[0].wrapper))
    assert "(<li>" in wrapper.expression() and "#TEXT" in wrapper.expression()


def main_texts(sources):
    wrappers = {}
    for source in sources:
        html._merge(wrappers, "h", html.Page(source).root)
    found = html.constants(html.Node.unpack(wrappers["h"].pack()))
    return [html.Page(source).main(found) for source in sources]


def test_html_constants_are_whole_texts():
    head = "word " * 60
    assert main_texts([f"<div><p>{head}{i}</p></div><p>own {i}</p>" for i in range(4)]) == [f"{head}{i}\nown {i}" for i in range(4)]
    assert main_texts([f"<div><p>{head}</p></div><p>own {i}</p>" for i in range(4)]) == [f"own {i}" for i in range(4)]


def test_html_copies_are_no_template():
    page = "<div><p>story</p></div><h2>end</h2><!-- {0} --><footer>{0}</footer>"
    assert main_texts([page.format(i) for i in range(5)]) == ["story\nend"] * 5
    assert main_texts([page.format(i) for i in range(5)] + ["<div><p>story</p></div><h2>other</h2>"]) == ["story\nend"] * 5 + ["story\nother"]
    assert main_texts(["<ul><li>same</li><li>same</li></ul>"] * 4) == ["same\nsame"] * 4


def test_html_wrapper_counts_within_the_article():
    page = '<article><h1>T{0}</h1><div class="x1">Share <a>here</a> <a>there</a></div><p>own {0}</p><ul class="q"><li>ours</li><li>ours</li></ul><ul><li>a {0}</li><li>b</li></ul></article>'
    assert main_texts([page.format(i) for i in range(4)]) == [f"T{i}\nown {i}\na {i}\nb" for i in range(4)]
    assert main_texts([page.format(i) for i in range(2)])[1] == "T1\nShare here there\nown 1\nours\nours\na 1\nb"


def page_of_groups(i, own):
    name = lambda n: "k" + "".join(chr(97 + n // 26**k % 26) for k in range(4))
    return '<div class="box"><p>Subscribe now</p></div>' + "".join(f'<section class="{name(i * own + k)}"><p>own {i} {k}</p></section>' for k in range(own))


def test_html_wrappers_take_in_every_page(spark, monkeypatch):
    own = lambda i, n: "\n".join(f"own {i} {k}" for k in range(n))
    sizes = [700, 1, 900, 2, 800, 3]  # over 2000 groups before the third page
    sources = [page_of_groups(i, n) for i, n in enumerate(sizes)]
    for order in (range(6), range(5, -1, -1)):
        assert main_texts([sources[i] for i in order]) == [own(i, sizes[i]) for i in order]
    # two hosts; the second one's pages are too few for a constant
    rows = [(i, "http://h/x", page) for i, page in enumerate(sources)] + [(10 + i, "http://g/x", sources[i]) for i in range(2)]
    want = {i: own(i, n) for i, n in enumerate(sizes)} | {10 + i: "Subscribe now\n" + own(i, sizes[i]) for i in range(2)}
    for limit, part, tasks in ((html.BROADCAST, html.PART, 1), (html.BROADCAST, html.PART, 5), (-1, html.PART, 3), (-1, 2, 3)):
        monkeypatch.setattr(html, "BROADCAST", limit)
        monkeypatch.setattr(html, "PART", part)
        got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(tasks)).collect()
        assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want


def test_html_groups_of_one_page_decide_nothing(spark, monkeypatch):
    rng = random.Random(1)

    def tree(depth):
        own = lambda: "k" + "".join(rng.choices("abcdefghij", k=12))
        inner = lambda: tree(depth - 1) if depth else f"t{rng.choice('aaaaaaaaab')}"
        return "".join(f'<div class="{own() if rng.random() < 0.3 else rng.choice("xyz")}">{inner()}</div>' for _ in range(rng.randint(1, 4)))

    rows = [(i, f"http://{i % 9}/x", "<p>all</p>" + tree(2)) for i in range(90)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).cache()
    found, texts, sizes = [], [], []
    for large in (html.LARGE, -1):
        monkeypatch.setattr(html, "LARGE", large)
        found.append({r.host: r.wrapper for r in html.infer(df, row=html._listed).collect()})
        texts.append({r.page_id: r.text for r in html.extract(df).collect()})
        sizes.append(sum(len(r.wrapper) for r in html.infer(df).collect()))
    assert found[0] == found[1] and texts[0] == texts[1] and sizes[1] < sizes[0]
    assert sum(w.count('"ta"') for w in found[0].values()) > 2


def test_html_nesting_has_no_bound(spark):
    rows = [(i, "http://h/x", "<div>" * 5000 + f"<p>Subscribe now</p><ul><li>own {i}</li></ul>") for i in range(4)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()
    assert {r.page_id: r.text for r in got} == {i: f"own {i}" for i in range(4)}


def test_html_children_align_by_a_longest_common_subsequence():
    rng = random.Random(0)
    for turn in range(400):
        x, y = (rng.choices("abcdefgh"[: rng.randint(1, 8)], k=rng.randint(0, 60 if turn % 10 else 200)) for _ in range(2))
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
        want, i, j = [], 0, 0
        while i < len(x) or j < len(y):
            if i < len(x) and j < len(y) and x[i] == y[j]:
                want.append((i, j))
                i, j = i + 1, j + 1
            elif j == len(y) or (i < len(x) and best[i + 1][j] >= best[i][j + 1]):
                want.append((i, -1))
                i += 1
            else:
                want.append((-1, j))
                j += 1
        assert list(html.common(x, y)) == want


def test_html_matches_articles_of_the_table(spark, sf):
    import html as stdlib

    for r, page in zip(html.op7_html(spark, sf).orderBy("page_id").collect(), spark.read.parquet(f"{sf}/pages.parquet").orderBy("page_id").collect()):
        inside = re.search(r"<article>(.*?)</article>", page.html, re.S)[1]
        blocks = [" ".join(stdlib.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)[^>]*>", inside)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    scores = {r.doc_id: r for r in quality.op8_quality(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [d for d in labels if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(scores[d].held_out for d in held) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scores.values())
    assert np.mean([scores[d].predicted == labels[d] for d in held]) > 0.93


def test_quality_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 0), (3, 1)], "doc_id long, quality int")
    rows = quality.classify(awkward, labels).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.classify(awkward, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(empty, labels).count() == 0


def test_quality_table_sums_are_exact():
    text = [b"a b c a b", b"x", b""]
    import pyarrow as pa

    blocks = {}
    batch = pa.RecordBatch.from_arrays([pa.array([t.decode() for t in text])], names=["text"])
    for out in quality._contexts(iter([batch]), 1):
        for i, _, blob in zip(*(out.column(k).to_pylist() for k in range(3))):
            blocks[i] = quality.wide(blob)
    table = np.concatenate([blocks[i] for i in range(len(blocks))])
    (b, doc), = quality.tokens(text)
    place, sign = quality.index_vectors()
    exact = np.zeros_like(table)
    for i in range(len(b)):
        exact[b[i], -1] += 1
        for j in range(len(b)):
            if doc[i] == doc[j] and 0 < abs(i - j) <= 2:
                for k in range(quality.NONZERO):
                    exact[b[i], place[b[j], k]] += sign[b[j], k]
    assert (table == exact).all()


def embedded(spark, rng, n=400, d=16):
    rows = []
    for i in range(n):
        v = rng.normal(size=d)
        if i % 3 and rows:
            v = np.array(rows[rng.integers(len(rows))][1] or np.ones(d)) + rng.normal(size=d) * 0.08
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 2)))
    rows += [(n, rows[0][1], 0), (n + 1, [2 * x for x in rows[0][1]], 0), (n + 2, None, 0), (n + 3, [0.0] * d, 0), (n + 4, [1.0, None], 0), (n + 5, [float("nan")] * d, 0), (n + 6, rows[0][1], None), (n + 7, [], 0), (None, rows[0][1], 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("longest", [4096, 16])
def test_embeddings_recall(spark, monkeypatch, longest):
    common.prepare(spark)
    monkeypatch.setattr(embeddings, "LIST", longest)
    rows, df = embedded(spark, np.random.default_rng(5))
    ok = lambda v: v and None not in v and np.isfinite(v).all() and any(v)
    unit = [np.array(np.float32(v), float) / np.linalg.norm(np.array(np.float32(v), float)) if ok(v) and lab is not None else None for _, v, lab in rows]
    exact = [[i != j and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98 for j in range(len(rows))] for i in range(len(rows))]
    got = {r.id: r for r in embeddings.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    links = [sum(x) for x in exact]
    assert all(got[r[0]].n_links <= n for r, n in zip(rows, links)) and sum(r.n_links for r in got.values()) >= 0.9 * sum(links)
    for i in (402, 403, 404, 405, 406, 407):
        assert got[i].n_links == 0 and got[i].kept
    assert got[0].component_id == got[400].component_id == got[401].component_id == got[None].component_id and not got[400].kept
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


CLASH = "out string, block string, slot string, position string, shard string, ids string, n_bytes string, exact string, media string, feature string, kept string, spans string, key string, score string, predicted string, n_near string, component_id string, same string, v string, p string, perm string, host string, wrapper string, m string, n string"


def test_extra_columns_with_clashing_names_and_very_long_texts(spark):
    """Every operator over documents: the same rows with and without clashing columns; texts cross every piece that kernels cut."""
    common.prepare(spark)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 8)))
    long = " ".join(word() for _ in range(150_000))
    rows = [(0, "short text of its own", "s"), (1, long, "s"), (2, long[:400_000] + "x" + long[400_000:], "t"), (3, None, None), (4, "é" * 300_000, "s"), (5, "no blank" * 40_000, "t")]
    assert len(long) > 2 * suffix.PIECE and len(long) > quality.PIECE
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    extra = CLASH.split(", ")
    clash = spark.createDataFrame([(*r, *["clash"] * len(extra)) for r in rows], f"doc_id long, text string, source string, {CLASH}").cache()
    labels = spark.createDataFrame([(0, 1), (5, 0), (1, 1)], "doc_id long, quality int")
    runs = {
        "mixing": lambda d: mixing.mix(d).select("doc_id", "block", "slot", "position"),
        "sharding": lambda d: sharding.assign(d, ["a", "b"], slots=101).select("doc_id", "slot", "shard"),
        "simhash": simhash.near_duplicates,
        "deduplicate": lambda d: simhash.deduplicate(d).select("doc_id", "text"),
        "quality": lambda d: quality.classify(d, labels),
        "pieces": lambda d: pieces.encode(d).selectExpr("id", "n_bytes", "size(ids)", "exact"),
        "media": lambda d: media.media(d).selectExpr("id", "payload_sha256", "media_sha256", "md5(cast(feature as string))"),
        "suffix": lambda d: suffix.without_repeats(d).selectExpr("doc_id", "md5(cast(text as binary))", "length(text)"),
    }
    for name, run in runs.items():
        a, b = (sorted(map(tuple, run(d).collect()), key=repr) for d in (plain, clash))
        assert len(a) and a == b, name
    fp = {r.id: r.fp & (2**64 - 1) for r in simhash.fingerprints(plain).collect()}
    assert fp == {i: brute_fingerprint((t or "").encode()) for i, t, _ in rows}
    assert {r.id: r.exact for r in pieces.encode(plain).collect()} == {i: True for i, *_ in rows}
    kept, _ = suffix.remove_repeats(plain)
    got = {r.key: bytes(r.kept) for r in kept.collect()}
    assert (got[1], got[2], got[4], got[5]) == (long.encode(), b"x", "é".encode(), b"no blank")
    page = f"<article><p>{long}</p></article>"
    web = lambda more, columns: spark.createDataFrame([(i, "http://h/x", page, *more) for i in range(3)], f"page_id long, url string, html string{columns}")
    for pages in (web((), ""), web(("c", "c", "c"), ", host string, wrapper string, text string")):
        assert {r.text for r in html.extract(pages).collect()} == {" ".join(long.split())}
    vectors = [(i, [1.0, float(i > 2), 0.5], 1, "c", "c") for i in range(6)]
    found = embeddings.near_duplicates(spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int, node string, least string"))
    assert sorted((r.id, r.n_links, r.component_id) for r in found.collect()) == [(i, 2, 0 if i < 3 else 3) for i in range(6)]


def test_queries_give_the_rows_of_their_sql(spark, sf):
    import duckdb

    from tessera.llm import queries

    con = duckdb.connect()
    for t in "documents embeddings conversations pages benchmark labels".split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, sf)
        names = sorted(df.columns)
        cur = con.execute(sql)
        order = [d[0] for d in cur.description]
        assert sorted(order) == names
        assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted((tuple(r[order.index(c)] for c in names) for r in cur.fetchall()), key=repr), name


def brute_codes(payload):
    """media.fingerprint by its definition: a Fourier sum per frame and frequency, then loops over frames, bands and pairs."""
    n = media.FRAME
    angle = -2j * np.pi * np.outer(np.arange(1, n // 2 + 1), np.arange(n)) / n
    window, base = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1)), np.exp(angle)
    x = np.frombuffer(payload, np.uint8).astype(float) - 128
    peaks = []
    for at in range(0, len(x), n):
        frame = np.r_[x[at : at + n], np.zeros(max(0, at + n - len(x)))]
        power = np.abs(base @ ((frame - frame.mean()) * window)) ** 2
        width = len(power) // media.BANDS
        bands = [power[b * width : (b + 1) * width] for b in range(media.BANDS)]
        peaks.append([(b * width + int(band.argmax())) if band.max() > 1e-6 else None for b, band in enumerate(bands)])
    out = []
    for t, here in enumerate(peaks):
        for d in range(media.REACH + 1):
            if t + d < len(peaks):
                out += [t << 32 | p << 20 | q << 8 | d for a, p in enumerate(here) for b, q in enumerate(peaks[t + d]) if p is not None and q is not None and (d or b > a)]
    return sorted(out)


def test_media_query_against_the_definition(spark, sf):
    got = {r.doc_id: r for r in media.op5_media(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert set(got) == {r.doc_id for r in rows}
    for r in rows:
        text = (r.text or "").encode()
        payload = media.pad(text)
        assert (got[r.doc_id].n_bytes, got[r.doc_id].payload_bytes, got[r.doc_id].payload_sha256) == (len(text), len(payload), hashlib.sha256(payload).hexdigest())
    for r in rows[:40]:
        assert got[r.doc_id].fingerprint == brute_codes(media.pad((r.text or "").encode()))
