"""Media, mixing, vectors and the pipeline."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.llm import common, embed_graph, gif, langid, mixing, packing, pii, simhash
from larkspan.llm.graph import components


def test_lzw_round_trip():
    rng = np.random.default_rng(0)
    for data in (b"", b"a", b"ab" * 40_000, bytes(100_000), rng.integers(0, 256, 70_000, dtype=np.uint8).tobytes(), b"aaaab" * 3000 + bytes(range(256))):
        assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data
    assert gif.lzw_decode(b"\xff\xff\xff", 8, 100) == b""


def test_gif_frames_disposal_and_transparency(spark):
    palette = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255] + [9] * 759)
    a, b = np.zeros((4, 4), np.uint8), np.full((2, 2), 1, np.uint8)
    b[0, 0] = 2
    blob = gif.encode_gif([a, b], palette, delay_cs=7, transparent=2)
    one, two = gif.decode_gif(blob)
    assert (one.canvas[..., :3] == [255, 0, 0]).all() and one.delay_cs == 7
    assert two.canvas[0, 0].tolist() == [255, 0, 0, 255] and two.canvas[1, 1].tolist() == [0, 255, 0, 255] and two.canvas[3, 3].tolist() == [255, 0, 0, 255]
    cleared = gif.decode_gif(gif.encode_gif([a, b], palette, disposal=2))[1]
    assert cleared.canvas[3, 3].tolist() == [0, 0, 0, 0] and cleared.canvas[1, 1].tolist() == [0, 255, 0, 255]
    back = gif.decode_gif(gif.encode_gif([a, b, b[:1, :1]], palette, disposal=3))[2]
    assert back.canvas[1, 1, 3] == 0 and back.canvas[0, 0].tolist() == [0, 0, 255, 255]
    rows = gif.gif_frames(spark, spark.createDataFrame([(1, bytearray(blob)), (2, None), (3, bytearray(b"no gif"))], "id long, media binary"), "id", "media").orderBy("id", "frame").collect()
    assert [(r.id, r.frame, r.start_ms, r.delay_ms) for r in rows] == [(1, 0, 0, 70), (1, 1, 70, 70), (3, None, None, None)] and rows[2].error
    assert sum(rows[0].histogram) == 16 and rows[0].histogram[0b110000] == 16 and len(rows[0].rgba) == 64


def test_interlaced_gif():
    rows = np.arange(64, dtype=np.uint8).reshape(16, 4)
    order = np.concatenate([np.arange(a, 16, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
    blob = bytearray(gif.encode_gif([rows[order]], gif.GREYS))
    blob[blob.index(b"\x2c\0\0\0\0\4\0\x10\0") + 9] |= 0x40
    assert (gif.decode_gif(bytes(blob))[0].canvas[..., 0] == rows).all()


def test_payload_in_colours():
    """Samples come back through palette, transparency and composition, and the histogram is that of their upper bits."""
    rng = np.random.default_rng(7)
    for n, top in ((1, 200), (5, 255), (3000, 200), (2500, 255)):
        payload = rng.integers(0, top + 1, n * gif.WIDTH, dtype=np.uint8)
        payload[gif.WIDTH * gif.ROWS : gif.WIDTH * (gif.ROWS + 40)] = payload[: max(0, min(40, n - gif.ROWS)) * gif.WIDTH]
        blob = gif.payload_to_gif(payload.tobytes())
        frames = gif.decode_gif(blob)
        assert gif.gif_to_payload(frames) == payload.tobytes()
        assert [f.transparent for f in frames] == [None if top == 255 or n <= gif.ROWS else gif.SEEN] * len(frames)
        want = np.bincount((payload >> 6).astype(int) << 4 | (payload >> 3 & 3).astype(int) << 2 | payload & 3, minlength=64) if n <= gif.ROWS else None
        assert want is None or (gif.histogram(frames[0].canvas) == want).all()


def test_text_media(spark, docs, none):
    stored = common.scratch(gif.text_media(spark, docs), "media")
    media = defaultdict(list)
    for r in stored.collect():
        media[r.doc_id].append(bytes(r.media))
    rows = gif.media_digest(spark, stored).collect()
    for r in rows:
        assert (r.media_bytes, r.media_sha256) in [(len(m), hashlib.sha256(m).hexdigest()) for m in media[r.doc_id]]
        colours = [sum(gif.histogram(f.canvas[f.top : f.top + f.height]) for f in gif.decode_gif(m)) for m in media[r.doc_id]]
        assert r.feature in [" ".join(f"{k}:{v}" for k, v in enumerate(c.tolist()) if v) for c in colours]
    want = Counter()
    for d in docs.collect():
        raw = (d.text or "").encode()
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        want[d.doc_id, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    for r in rows:
        assert sum(int(x.split(":")[1]) for x in r.feature.split()) >= r.payload_bytes
    assert max(r.n_frames for r in rows) > 1
    assert gif.media_digest(spark, gif.text_media(spark, none)).count() == 0


def brute_targets(sizes):
    """Shares reshared until none is above twice its size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    total = 1.5 * sum(sizes.values())
    target, full = {}, set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else left * weight[s] / w for s in names}
        over = {s for s in names if s not in full and target[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


def words(text):
    import re

    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check_mix(rows, texts):
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((d.doc_id, words(d.text)) for d in texts)
    sizes = defaultdict(int)
    for d in texts:
        sizes[d.source] += words(d.text)
    target = brute_targets(dict(sizes))
    return sizes, target


def test_mixing(spark, docs, odd, none):
    texts = docs.collect()
    rows = mixing.mix_counts(spark, docs).collect()
    sizes, target = check_mix(rows, texts)
    source = {d.doc_id: d.source for d in texts}
    taken = defaultdict(int)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - t) <= 0.5 for s, t in target.items())
    again = mixing.mix_counts(spark, docs.repartition(7)).collect()
    assert Counter((r.doc_id, r.taken) for r in rows) == Counter((r.doc_id, r.taken) for r in again)
    # What each text gives by brute force: whole passes, and the head of the hash order for the rest.
    want, at = Counter(), defaultdict(int)
    keyed = docs.select("doc_id", "text", "source", F.xxhash64("doc_id", F.lit(17)).alias("key"), F.xxhash64("text").alias("h")).collect()
    for d in sorted(keyed, key=lambda d: ((d.key & (2**64 - 1)) >> 33, d.key, d.doc_id or -1, words(d.text), d.h)):
        passes, rest = divmod(int(target[d.source] + 0.5), max(1, sizes[d.source]))
        n = words(d.text)
        want[d.doc_id, passes * n + max(0, min(n, rest - at[d.source]))] += 1
        at[d.source] += n
    assert Counter((r.doc_id, r.taken) for r in rows) == want
    assert mixing.mix_counts(spark, odd).count() == odd.count()
    assert mixing.mix_counts(spark, none).count() == 0 and mixing.mix_documents(spark, none).count() == 0
    zero = odd.where("text IS NULL OR trim(text) = ''")
    assert {r.taken for r in mixing.mix_counts(spark, zero).collect()} == {0}


def test_small_sources_reach_their_targets(spark):
    """Sources of a few words beside two large ones take their target to the word."""
    sizes = {"a": 200_000, "b": 200_000, "c": 1, "d": 2, "e": 5, "f": 7, "g": 33, "h": 97, "i": 300}
    rows = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate((s, k) for s, n in sizes.items() for k in ([n] if n <= 300 else [n // 400] * 400))]
    got = mixing.mix_counts(spark, spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    source, taken = {r[0]: r[2] for r in rows}, Counter()
    for r in got:
        taken[source[r.doc_id]] += r.taken
        assert r.taken <= 2 * r.size
    assert all(abs(taken[s] - t) <= 0.5 for s, t in brute_targets(sizes).items())


def test_mixing_rows_that_share_an_id(spark):
    rows = [(k, " ".join(f"t{i}w{j}" for j in range(5 + i % 9)), "ab"[i % 2]) for i in range(60) for k in ([7, None][i % 2],)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_documents(spark, docs, chars_col=None).collect()
    taken = Counter()
    for r in out:
        taken[r.source] += words(r.text)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    assert all(abs(taken[s] - t) <= 0.5 for s, t in brute_targets(dict(sizes)).items())
    heads = {t for _, t, _ in rows}
    assert all(any(h == r.text or h.startswith(r.text + " ") for h in heads) for r in out)


def test_schedule_interleaves_sources(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    _, mix = mixing.schedule(spark, docs)
    rows = mix.select("slot", "sid").distinct().orderBy("slot").collect()
    n = max(r.slot for r in rows) + 1
    share = Counter(r.sid for r in rows)
    for part in (0, 1, 2):
        some = Counter(r.sid for r in rows if part * n // 4 <= r.slot < (part + 1) * n // 4)
        assert all(abs(some[s] - share[s] / 4) <= 0.1 * share[s] + 6 for s in share)


def test_mix_documents_take_effect(spark, odd, docs):
    counts = {r.doc_id: r.taken for r in mixing.mix_counts(spark, docs.where("doc_id IS NOT NULL AND doc_id != 1000005")).collect()}
    out = mixing.mix_documents(spark, docs.where("doc_id IS NOT NULL AND doc_id != 1000005"))
    assert out.columns == docs.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += words(r.text)
        assert r.n_chars == len(r.text)
    assert {k: v for k, v in counts.items() if v} == dict(got)
    assert mixing.mix_documents(spark, odd).columns == odd.columns


def brute_links(vectors):
    ok = {i: np.array(v, float) for i, v in vectors if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    near = defaultdict(set)
    for i, a in ok.items():
        for j, b in ok.items():
            if i != j and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95:
                near[i].add(j)
    return near


def brute_component(near, i):
    todo, seen = [i], {i}
    while todo:
        for y in near[todo.pop()] - seen:
            seen.add(y)
            todo.append(y)
    return min(seen)


def test_cells_in_levels(monkeypatch):
    """As many cells as are wanted from few centroids, and the nearest found first."""
    monkeypatch.setattr(embed_graph, "CENTROIDS", 8)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = embed_graph.codebooks(x, 300)
    assert len(books) == 3 and np.prod([len(b) for b in books]) >= 300 and max(map(len, books)) <= 8
    cells = embed_graph.cells_of(x, books, 4)
    assert cells.shape == (4000, 4) and np.bincount(embed_graph.cells_of(x, books, 1)[:, 0]).max() < 400
    near = x + rng.normal(size=x.shape) * 0.01
    assert np.mean([bool(set(a) & set(b)) for a, b in zip(cells.tolist(), embed_graph.cells_of(near, books, 4).tolist(), strict=True)]) > 0.98


@pytest.mark.parametrize(("cap", "most"), [(2000, 4096), (40, 4096), (2000, 3)])
def test_embedding_graph(spark, monkeypatch, cap, most):
    monkeypatch.setattr(embed_graph, "CAP", cap)
    monkeypatch.setattr(embed_graph, "CENTROIDS", most)
    monkeypatch.setattr(embed_graph, "MEAN", 100)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    rows = [(i, (base[i % 40] + rng.normal(size=16) * (0.1 if i % 3 else 0.4)).tolist()) for i in range(500)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] + [1.0] * 15), (1003, [None] + [1.0] * 15), (1004, [float("inf")] + [1.0] * 15), (1005, []), (1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (1008, rows[0][1]), (1009, [3 * x for x in rows[0][1]]), (1010, rows[0][1])]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<double>, node string")
    got = {r.vec_id: r for r in embed_graph.near_duplicates(spark, df).collect()}
    near = brute_links(rows)
    assert len(got) == len(rows)
    true, found = sum(map(len, near.values())), sum(r.n_links for r in got.values())
    assert found <= true and found >= 0.9 * true
    exact = sum(got[i].n_links == len(near[i]) for i, _ in rows)
    assert exact >= 0.95 * len(rows)
    assert sum(got[i].component_id == brute_component(near, i) for i, _ in rows) >= 0.95 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert all(got[i].n_links == 0 for i in range(1000, 1006)) and got[1006].n_links == got[1007].n_links == 1


@pytest.mark.parametrize("cap", [2000, 100])
def test_embedding_graph_crowded(spark, monkeypatch, cap):
    """A third of the rows in one group of near copies: every pair is found, though shards of any overlap part them."""
    monkeypatch.setattr(embed_graph, "CAP", cap)
    monkeypatch.setattr(embed_graph, "MEAN", 10)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 32))
    x[:300] = x[0] + rng.normal(size=(300, 32)) * 0.15 * np.linalg.norm(x[0]) / 32**0.5
    x[300:600] = x[rng.integers(600, 900, 300)] + rng.normal(size=(300, 32)) * 0.2
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= embed_graph.THRESHOLD
    np.fill_diagonal(near, False)
    got = embed_graph.near_duplicates(spark, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), overlap=1).collect()
    assert near[:300].sum() > 40_000 and {r.vec_id: r.n_links for r in got} == dict(enumerate(near.sum(axis=1).tolist()))


def test_embedding_graph_refuses_low_recall(spark, monkeypatch):
    monkeypatch.setattr(embed_graph, "audit", lambda *_: (1, 2))
    rows = spark.createDataFrame([(i, [1.0, i / 100]) for i in range(20)], "vec_id long, embedding array<double>")
    with pytest.raises(RuntimeError, match="1 of 2"):
        embed_graph.near_duplicates(spark, rows).count()


def test_mixing_points_over_chunks():
    """The points of all chunks are one golden-ratio sequence, of low discrepancy."""
    n = 700_000
    slot = np.arange(n)
    points = (slot // mixing.CHUNK * mixing._PHI_CHUNK + (slot % mixing.CHUNK + 1) * mixing._PHI) % 1
    gap = np.abs(points - (slot + 1) * mixing._PHI % 1)
    assert np.minimum(gap, 1 - gap).max() < 1e-6
    p = np.sort(points) * n
    assert max((slot + 1 - p).max(), (p - slot).max()) < 6


def test_embedding_graph_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embed_graph.near_duplicates(spark, none).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in (3, 4, 4)], "vec_id long, embedding array<float>")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in embed_graph.near_duplicates(spark, same).collect()) == [(3, 2, 3), (4, 2, 3), (4, 2, 3)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (201, 202), (202, 201), (None, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(61)}) == 1 and len({got[i] for i in range(100, 160)}) == 1 and got[201] == got[202] and 200 not in got
    assert len(set(got.values())) == 3
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark, sf, docs, tmp_path):
    """Each stage against a plain version on its own input, and run() against the stages."""
    import corpus_pipeline as P

    path = str(tmp_path)
    foreign = spark.createDataFrame([(2_000_000, "\u041f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440, \u043a\u0430\u043a \u0434\u0435\u043b\u0430", None, "a", 20), (None, "a second row without an id, of its own words", "en", "a", 44)], docs.schema)
    docs = docs.unionByName(foreign).withColumn("fp", F.lit("clash")).withColumn("row", F.lit(1))
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    now = spark.read.parquet(f"{path}/documents.parquet")
    assert [name for name, _ in P.STAGES] == ["language ID", "SimHash near-dedup", "PII pseudonyms", "mixing", "packing"]
    for k, (_, stage) in enumerate(P.STAGES):
        before = now.collect()
        out = common.scratch(stage(spark, now, path), f"stage{k}")
        rows = out.collect()
        if k < 4:
            assert out.columns == now.columns
        if k == 0:
            assert Counter(rows) == Counter(r for r in before if any(c.isalpha() for c in r.text or "") and r.doc_id != 2_000_000)
        elif k == 1:
            from tests.llm.test_texts import brute_components, brute_fingerprint

            prints = defaultdict(list)
            for i, r in enumerate(before):
                prints[brute_fingerprint(r.text)].append(i)
            groups = defaultdict(list)
            for f, g in brute_components(prints).items():
                groups[g] += [(before[i].doc_id is not None, before[i].doc_id or 0) for i in prints[f]]
            assert Counter((r.doc_id is not None, r.doc_id or 0) for r in rows) == Counter(min(x) for x in groups.values()) and set(rows) <= set(before)
        elif k == 2:
            assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, pii.pseudonymise(r.text, P.QUERY_KEY)[0]) for r in before)
        elif k == 3:
            sizes, taken = defaultdict(int), defaultdict(int)
            for r in before:
                sizes[r.source] += words(r.text)
            for r in rows:
                taken[r.source] += words(r.text)
            for s, t in brute_targets(dict(sizes)).items():
                assert abs(taken[s] - t) <= 0.5
        else:
            want = defaultdict(int)
            for r in before:
                want[r.doc_id] += 1
            assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(want)
            assert all(r.offset + r.length <= packing.LENGTH for r in rows)
        now = out
    whole = P.run(spark, path).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in whole) == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)


def test_pipeline_without_labels_or_rows(spark, odd, none, tmp_path):
    """An unlabelled corpus keeps its texts with letters; an empty one and columns with operators' names go through."""
    import corpus_pipeline as P

    for k, table in enumerate((odd.withColumn("lang", F.lit(None).cast("string")), none)):
        path = f"{tmp_path}/{k}"
        table.write.parquet(f"{path}/documents.parquet")
        docs = spark.read.parquet(f"{path}/documents.parquet")
        kept = P.language(spark, docs, path)
        assert kept.columns == docs.columns
        assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or ""))
        rows = P.run(spark, path).collect()
        assert bool(rows) == (k == 0) and all(r.length > 0 for r in rows)


def test_registered_queries(spark, sf):
    import __spark_entry__ as E

    names = E.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert simhash.fingerprint_hex(F.lit(-1)) is not None and langid.PROFILE > 0
