"""Each operator against a brute-force version, and on nulls, ties and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sedimark.llm import exact_dedup, max_score, near_dedup, packing, piece_dropout, quality, queries, secret_scan, sharding, token_store, zip_archives
from sedimark.llm._common import shared_folder
from sedimark.llm.components import connected_components
from sedimark.llm.word_tokens import WordEncoder, tokenizer_path


def plain_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def words_of(text):
    low = text.translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", low)


# secrets


def brute_secrets(text):
    found = []
    for kind, pattern, test in (
        ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
    ):
        found += [(m.start(), ["assign", "access", "hex"].index(kind), f"{kind}:{m.start()}:{m.end()}", kind) for m in re.finditer(pattern, text) if test(m)]
    return sorted(found)


def test_secrets_match_brute_force(docs, texts):
    rows = secret_scan.scan(docs).collect()
    want = Counter()
    for doc, text in texts:
        found = brute_secrets(text or "")
        n = Counter(f[3] for f in found)
        want[doc, n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(f[2] for f in found).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows) == want
    for r in rows:
        base = [f[2] for f in brute_secrets(dict(texts)[r.doc_id] or "")]
        assert not set(base) - set(r.spans.split(","))


def test_entropy_windows_match_direct_computation():
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice("abcdefABCDEF0123456789" if rng.random() < 0.7 else "aab") for _ in range(rng.randint(10, 90)))
        window, threshold = rng.choice([(16, 3.0), (20, 3.4), (24, 2.5)])
        covered = [False] * len(text)
        for i in range(len(text) - window + 1):
            h = -sum(c / window * math.log2(c / window) for c in Counter(text[i : i + window]).values())
            if h >= threshold - 1e-12:
                covered[i : i + window] = [True] * window
        got = [False] * len(text)
        for a, b in secret_scan.entropy_spans(text, window, threshold):
            got[a:b] = [True] * (b - a)
        assert got == covered


def test_allow_list_suppresses_the_windows_that_overlap_it():
    scanner = secret_scan.Scanner(secret_scan.ScanRules())
    key = "wJalrXUtnFEMI7K4MDENGbPxRfiCYzv9Qd0T"
    for text in ("123e4567-e89b-12d3-a456-426614174000", "thorheonandtheatingoutherwholeinterationable", "EXAMPLE" + key[:19], "0123456789abcdef0123", "THEQUICKBROWNFOXJUMPSOVER", "iteration2024of1999"):
        assert scanner.added(text) == []
    assert [(a, b, k) for a, b, k in scanner.added(f"key {key} end")] == [(4, 40, "entropy_base64")]
    assert scanner.added(f"{key}EXAMPLE{key}") == [(0, 36, "entropy_base64"), (43, 79, "entropy_base64")]
    padded = "x" * 30 + "/" + key + "/" + "placeholder"
    assert [k for *_, k in scanner.added(padded)] == ["entropy_base64"]


def test_every_class_of_keys_is_looked_at():
    scanner = secret_scan.Scanner(secret_scan.ScanRules())
    cases = {
        "entropy_lower": ["q7w2k9z4m1x8p3v6t5r0", "sk_live_4h8fj2kq9zt5w1mx7pd3"], "entropy_upper": ["JBSWY3DPEHPK3PXPKRUG", "K5QXG2LOM4ZWK7TBNRUWY2LP"],
        "entropy_hex": ["0x9F3A7C5E1B8D2046", "0x9f3a7C5e1b8d20469f1a7C5e", "9F3A7C5E1B8D2046"], "entropy_base64": ["aB3dE6gH9jK2mN5pQ8rT"],
    }
    for kind, keys in cases.items():
        for key in keys:
            assert kind in [k for *_, k in scanner.added(f"see {key}, then")], key


def test_a_class_may_need_more_than_a_run():
    rules = secret_scan.ScanRules((secret_scan.EntropyClass("own", r"[A-Z]+[0-9]+", 16, 2.0),))
    assert [k for *_, k in secret_scan.Scanner(rules).added("QWKEHTZNGLM7391846205")] == ["own"]


def test_scan_of_nothing(empty):
    assert secret_scan.scan(empty).count() == 0
    assert secret_scan.redacted(empty).columns == empty.columns and secret_scan.redacted(empty).count() == 0


def test_redaction_hides_every_span(docs):
    rows = secret_scan.redacted(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.text is None or not brute_secrets(r.text)
    assert {r.text for r in rows if r.doc_id == 13} == {"a [SECRET] b"} or any("[SECRET]" in r.text for r in rows if r.doc_id == 13)


# token ids


def test_word_encoder_gives_the_library_s_ids(texts):
    plain, mine = plain_tokenizer(), WordEncoder(tokenizer_path(), memo_bytes=10_000)
    odd = ["", " \x1c a\x1fb c", "don't <|endoftext|>x ß ẞ İstanbul é É́ ́a", "ﬁ Å ẛ̣ 12 3a b c", "x" * 3000, "a'S it'Re İ ﬀ", "日本 語"]
    cases = [t or "" for _, t in texts] + odd
    got = list(mine.encode(cases, group_chars=500))
    assert [x.tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in cases]


def test_word_encoder_refuses_other_tokenizers():
    with pytest.raises(ValueError):
        WordEncoder(tokenizer_path("byte_bpe_50k.json"))


def test_segment_gives_random_access():
    rng = np.random.default_rng(3)
    for high in (200, 60_000, 1 << 31):
        ids = rng.integers(0, high, 3000).astype(np.int64)
        borders = np.array([0, 10, 10, 2000, 3000])
        segment = token_store.Segment(token_store.encode_segment(ids, borders, np.arange(4), np.zeros(4, bool)))
        assert segment.tokens().tolist() == ids.tolist()
        assert [segment.token(i) for i in range(0, 3000, 37)] == ids[::37].tolist()
        data, taken = b"front" + token_store.encode_segment(ids, borders, np.arange(4), np.zeros(4, bool)), []
        in_file = token_store.SegmentFile(lambda at, n, data=data, taken=taken: taken.append(n) or data[at : at + n], 5)
        taken.clear()
        assert [in_file.token(i) for i in range(0, 3000, 37)] == ids[::37].tolist()
        assert sum(taken) < 82 * 3 * 80


def test_token_files_hold_every_document(spark, docs, texts):
    rows = token_store.read_tokens(token_store.write_tokens(docs, shared_folder(spark), tokenizer_path(), end_id=2, segment_ids=1000)).collect()
    plain = plain_tokenizer()
    at, want = 0, []
    for doc, text in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((at, doc, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want


def test_tokens_by_their_numbers(spark, docs):
    manifest = token_store.write_tokens(docs, shared_folder(spark), tokenizer_path(), end_id=2, segment_ids=1000)
    plain, starts = plain_tokenizer(), token_store.read_tokens(manifest).collect()
    total = max(r.start + r.n_tokens for r in starts)
    numbers = [*range(0, total, 997), total - 1, total, -1, None, 0]
    got = Counter((r.number, r.token) for r in token_store.tokens_at(manifest, spark.createDataFrame([(n,) for n in numbers], "number long"), 1000).collect())
    text, long = next(r.text for r in docs.collect() if r.doc_id == 11), next(r for r in starts if r.doc_id == 11)
    ids = [*plain.encode(text, add_special_tokens=False).ids, 2]
    assert Counter(n for n, _ in got.elements()) == Counter(numbers)
    assert all((t is None) == (n is None or not 0 <= n < total) for n, t in got)
    assert all(ids[n - long.start] == t for n, t in got if n is not None and long.start <= n < long.start + long.n_tokens)


def test_token_files_of_an_empty_table(spark, empty):
    assert token_store.read_tokens(token_store.write_tokens(empty, shared_folder(spark), tokenizer_path(), end_id=2)).count() == 0


def test_tokens_by_numbers_of_an_empty_store(spark, empty):
    manifest = token_store.write_tokens(empty, shared_folder(spark), tokenizer_path(), end_id=2)
    asked = spark.createDataFrame([(0,), (7,), (None,)], "number long")
    assert [r.token for r in token_store.tokens_at(manifest, asked).collect()] == [None] * 3


# exact duplicates


def test_cuckoo_index_against_a_dictionary():
    rng, index, want = random.Random(2), exact_dedup.CuckooIndex(buckets=2), {}
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for _ in range(12_000):
        key = rng.choice(keys)
        if rng.random() < 0.3:
            assert index.delete(key) == want.pop(key, -1)
        else:
            ref = index.insert(key)
            assert want.setdefault(key, ref) == ref
    assert dict(index.items()) == want and len(index) == len(want) == len(set(want.values()))
    assert all(index.get(k) == want.get(k, -1) for k in keys)


def test_index_takes_few_bytes_a_digest():
    groups, n = exact_dedup._Groups(), 150_000
    for i in range(n):
        groups.add(hashlib.sha256(i.to_bytes(4, "little")).digest(), i, i, 1)
    assert groups.index.nbytes + 25 * n < 90 * n  # 5 million: 300 to 450 MB; tasks are meant for one million
    assert sum(b.num_rows for b in groups.batches()) == n


def test_emptied_indexes_give_the_same_groups(docs, texts, monkeypatch):
    want = sorted(map(str, exact_dedup.exact_groups(docs).select("doc_id", "keep_id", "group_size", "text_sha256").collect()))
    monkeypatch.setattr(exact_dedup, "LOCAL", 2)
    monkeypatch.setattr(exact_dedup, "MERGED", 3)
    assert sorted(map(str, exact_dedup.exact_groups(docs).select("doc_id", "keep_id", "group_size", "text_sha256").collect())) == want


def test_exact_groups(docs, texts):
    by = defaultdict(list)
    for doc, text in texts:
        by[text or ""].append(doc)
    rows = exact_dedup.exact_groups(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        group = next(g for t, g in by.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(group)
        assert r.keep_id == max((d for d in group if d is not None), default=None)
    assert Counter(r.text_sha256 for r in rows if r.kept) == Counter({r.text_sha256: 1 for r in rows})


def test_exact_duplicates_of_nothing(empty):
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.drop_exact_duplicates(empty).columns == empty.columns
    assert exact_dedup.drop_exact_duplicates(empty).count() == 0


def test_several_rows_that_repeat_id_and_text(spark):
    rows = [(i % 3 or None, "ab"[i % 2]) for i in range(24)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter((r.doc_id, r.text) for r in exact_dedup.drop_exact_duplicates(frame).collect())
    assert got == Counter([(2, "a"), (2, "b")])


def test_exact_duplicates_go(docs, texts):
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert Counter(r.text or "" for r in rows) == Counter({t or "": 1 for _, t in texts})
    assert {r.doc_id for r in rows if r.text == texts[5][1]} == {max(d for d, t in texts if t == texts[5][1])}


# search


def brute_top(rows, k=5):
    codes = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in codes:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(codes[q], v, strict=False)), i) for i, v in codes.items() if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["normal", "ties", "few"])
def test_max_score_is_exact(spark, kind):
    rng = np.random.default_rng(4)
    n = {"normal": 400, "ties": 300, "few": 3}[kind]
    rows = [(i, [float(x) for x in (rng.normal(size=12) if kind == "normal" else rng.integers(-1, 2, 12) / 8)]) for i in range(n)]
    rows += [(1000, None), (1050, [1.0, None] + [0.0] * 10), (1100, [float("nan")] * 12), (1150, [float("inf")] * 12), (None, [1.0] * 12)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = max_score.embedding_top_k(frame).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(rows)


def test_most_rows_of_sparse_vectors_are_never_looked_at():
    rng = np.random.default_rng(3)
    rows = np.where(rng.random((4000, 100)) < 0.04, rng.integers(1, 200, (4000, 100)), 0)
    shard = max_score.Shard(np.arange(4000), rows)
    for own in range(0, 400, 20):
        found, scores = shard.search(own, rows[own], 5)
        want = sorted((-int(rows[i] @ rows[own]), i) for i in range(4000) if i != own)[:5]
        assert [(-s, i) for i, s in zip(found.tolist(), scores.tolist(), strict=True)] == want
    assert shard.looked_at < 0.5 * 20 * 4000 and shard.probed < 0.25 * 20 * 4000 * 100


def test_dense_vectors_are_dropped_before_their_last_dimension():
    rng = np.random.default_rng(3)
    rows = np.floor(256 * rng.normal(size=(2000, 64)) / 8).astype(np.int64)
    shard = max_score.Shard(np.arange(2000), rows)
    for own in range(40):
        found, scores = shard.search(own, rows[own], 5)
        assert [(-s, i) for i, s in zip(found.tolist(), scores.tolist(), strict=True)] == sorted((-int(rows[i] @ rows[own]), i) for i in range(2000) if i != own)[:5]
    assert shard.probed < 0.8 * 40 * 2000 * 64


def test_huge_components_and_clashing_names(spark):
    """Scores are Python's, whatever the size of the components."""
    rows = [(0, [40000.0, -40000.0]), (50, [1e5, 1.0]), (2, [-1.0, 2.0]), (3, []), (100, [0.5, -0.25]), (4, [3e5, 2e6]), (5, [2.0**30, 0.0]), (6, [33000.0, 1 / 3])]
    schema = "vec_id long, embedding array<double>, shard int, codes int, score int"
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], schema)
    codes = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    want = []
    for q in (0, 50, 100):
        scored = sorted((-sum(a * b for a, b in zip(codes[q], v, strict=False)), i) for i, v in codes.items() if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    got = [tuple(r) for r in max_score.embedding_top_k(frame).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(got) == sorted(want) and (0, 100) in {(q, i) for q, _, i, _ in got}


def test_scores_beyond_64_bits_are_refused(spark):
    frame = spark.createDataFrame([(0, [3e38]), (1, [1e30])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="doesn't fit 64 bits"):
        max_score.embedding_top_k(frame).collect()
    small = spark.createDataFrame([(0, [3e38]), (1, [0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in max_score.embedding_top_k(small).collect()] == [(0, 1, 1, 0)]


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.5, 0.0]), (1, [2.0, 0.0]), (2, [0.25, 0.0])]
    got = max_score.embedding_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 256 * 512), (1, 256 * 128), (1, 256 * 128), (2, 256 * 64)]


def test_search_over_nothing(spark):
    assert max_score.embedding_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# shards


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation_is_one(n):
    for seed in (0, 1, 99):
        assert sorted(sharding.permute(np.arange(n), n, seed).tolist()) == list(range(n))


def test_shards_are_even_and_repeatable(docs, texts):
    first, again = sharding.shard_rows(docs, 7).collect(), sharding.shard_rows(docs.repartition(2), 7).collect()
    assert Counter(map(tuple, first)) == Counter(map(tuple, again))
    by = defaultdict(list)
    for r in first:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by[s]) for s in range(7)]
    assert sum(sizes) == len(texts) and max(sizes) - min(sizes) <= 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in first) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in texts)


def test_shards_of_nothing(empty):
    assert sharding.shard_rows(empty).count() == 0


# packing


def test_sum_of_squares_takes_the_best_level():
    rng, packer = random.Random(6), packing.SumOfSquares(32)
    for k in range(500):
        size = rng.randint(1, 31)
        levels = packer.levels.copy()

        def total(level, size=size, levels=levels):
            after = levels.copy()
            if level:
                after[level] -= 1
            if level + size < 32:
                after[level + size] += 1
            return int((after[1:32] ** 2).sum())

        allowed = [0] + [h for h in range(1, 33 - size) if levels[h]]
        assert total(packer.level_for(size)) == min(map(total, allowed))
        packer.add(k, size)


def test_windows_stay_open_however_many():
    packer = packing.SumOfSquares(100)
    assert not any(packer.add(k, 60) for k in range(10_000))
    assert packer.levels[60] == 10_000 and len(packer.add("fits", 40)) == 1
    assert sum(sum(p[2] for p in w) < 100 for w in packer.finish()) <= 1


@pytest.mark.parametrize("window", [16, 64, 2048])
def test_every_id_is_packed_once(docs, texts, window):
    rows = packing.pack(docs, tokenizer_path(), end_id=1, window=window).collect()
    plain = plain_tokenizer()
    want = Counter()
    for doc, text in texts:
        want[doc, len(plain.encode(text or "", add_special_tokens=False).ids) + 1] += 1
    got, filled = Counter(), defaultdict(list)
    for r in rows:
        got[r.doc_id, r.doc_tokens] += r.length
        filled[r.sequence_id].append((r.offset, r.length))
    assert got == Counter({k: k[1] * n for k, n in want.items()})
    short = 0
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= window
        short += at < window
    assert short <= docs.rdd.getNumPartitions()


def test_pieces_have_their_ids(docs, texts):
    plain = plain_tokenizer()
    by = defaultdict(list)
    for doc, text in texts:
        by[doc].append(np.array(plain.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4"))
    for r in packing.pack(docs, tokenizer_path(), end_id=1, window=64).collect():
        assert any(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for ids in by[r.doc_id])


def test_packing_of_nothing(empty):
    assert packing.pack(empty, tokenizer_path(), end_id=1).count() == 0


# pieces


def test_pieces_without_dropout_are_the_library_s(texts):
    import sentencepiece

    model = tokenizer_path(piece_dropout.PIECE_BPE)
    sp, mine = sentencepiece.SentencePieceProcessor(model_file=model), piece_dropout.PieceCodec(model, 0.0)
    cases = [t or "" for _, t in texts] + ["  a  b ", "日本語 🙂\n\t", "<0x0A> <s>", "x" * 300, " ", ""]
    ids, borders = mine.encode_all(cases, np.arange(len(cases)))
    assert [ids[a:b].tolist() for a, b in zip(borders, borders[1:], strict=False)] == sp.encode(cases)
    assert mine.decode_all(ids, borders) == cases


def naive_pieces(codec, text, doc_id):
    """Dropout BPE by looking at all pairs of a unit again at each step."""
    mix = lambda x: int(piece_dropout.mix64(np.array([x % 2**64], dtype=np.uint64))[0])
    name, out = {i: p for p, i in codec.ids.items()}, []
    for place, unit in enumerate(re.findall(r" *[^ ]+| +", " " + text) if text else []):
        key, parts, skipped = mix(place + mix(int(codec.seed) ^ mix(doc_id))), [], set()
        for c in unit:
            mark = "▁" if c == " " else c if c != "▁" else None
            parts += [codec.ids[mark]] if mark in codec.ids else [int(codec.byte_ids[b]) for b in c.encode()]
        parts = list(enumerate(parts))
        while True:
            pairs = []
            for k, ((i, a), (_, b)) in enumerate(zip(parts, parts[1:], strict=False)):
                made = codec.ids.get(name.get(a, "\0") + name.get(b, "\0"))
                if made is not None and (i, a, b) not in skipped:
                    pairs.append((codec.order[made], i, k, made))
            if not pairs:
                break
            _, i, k, made = min(pairs)
            if mix(key + ((i << 21) + made + 1) * 0x9E3779B97F4A7C15) >> 11 < int(codec.limit):
                skipped.add((i, parts[k][1], parts[k + 1][1]))
            else:
                parts[k : k + 2] = [(i, made)]
        out += [p for _, p in parts]
    return out


@pytest.mark.parametrize("longest", [0, 5, 48])
def test_dropout_against_a_naive_version_and_lossless(texts, longest):
    codec = piece_dropout.PieceCodec(tokenizer_path(piece_dropout.PIECE_BPE), 0.3, 11, 64, longest)
    cases = [(t or "")[:300] for _, t in texts] + ["a▁b ▁ c▁", "\x00 �", " " + "the" * 30, "  x   y "]
    ids, borders = codec.encode_all(cases, np.arange(len(cases)))
    for n, (text, a, b) in enumerate(zip(cases, borders, borders[1:], strict=False)):
        assert ids[a:b].tolist() == naive_pieces(codec, text, n)
    assert codec.decode_all(ids, borders) == cases
    assert len({tuple(codec.encode(cases[5], d)) for d in range(20)}) > 10


def test_every_pair_of_every_occurrence_is_dropped_at_the_rate():
    codec = piece_dropout.PieceCodec(tokenizer_path(piece_dropout.PIECE_BPE), 0.1, 7)
    keys = codec.keys(np.repeat(np.arange(20), 10_000), np.tile(np.arange(10_000), 20))
    n, coins = len(keys), {}
    for place in range(6):
        for piece in (5, 300, 31_999):
            coins[place, piece] = codec.skips(keys, np.full(n, place), np.full(n, piece))
            assert abs(coins[place, piece].mean() - 0.1) < 0.005
    for a in coins:  # whichever two pairs: one is dropped as often where the other is
        for b in coins:
            assert a == b or abs(coins[b][coins[a]].mean() - 0.1) < 0.015
    for step in (1, 2, 5):  # and so from a unit to those after it
        same = coins[0, 300]
        assert abs(same[step:][same[:-step]].mean() - 0.1) < 0.015


def test_a_common_word_has_its_segmentations_by_their_chances():
    codec = piece_dropout.PieceCodec(tokenizer_path(piece_dropout.PIECE_BPE), 0.1, 7)
    unit, n = " nation", 20_000
    ids, borders = codec.encode_all([unit[1:]] * n, np.arange(n))
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(borders, borders[1:], strict=False))
    law, open_ways, name = Counter(), [()], {i: p for p, i in codec.ids.items()}
    while open_ways:  # the law of each segmentation, from all ways the coins can fall
        way, steps, skipped = open_ways.pop(), [], set()
        parts = [(i, codec.ids["▁" if c == " " else c]) for i, c in enumerate(unit)]
        while True:
            pairs = [(codec.order[m], i, k, m) for k, ((i, a), (_, b)) in enumerate(zip(parts, parts[1:], strict=False)) if (m := codec.ids.get(name[a] + name[b])) is not None and (i, a, b) not in skipped]
            if not pairs:
                break
            _, i, k, made = min(pairs)
            steps.append(len(steps) < len(way) and way[len(steps)])
            if steps[-1]:
                skipped.add((i, parts[k][1], parts[k + 1][1]))
            else:
                parts[k : k + 2] = [(i, made)]
        law[tuple(p for _, p in parts)] += math.prod(0.1 if s else 0.9 for s in steps)
        open_ways += [(*steps[:k], True) for k in range(len(way), len(steps))]
    assert len(seen) > 2 and abs(sum(law.values()) - 1) < 1e-9 and set(seen) <= set(law)
    assert all(abs(seen[ids] - n * p) < 5 * math.sqrt(n * p) + 1 for ids, p in law.items())
    for rate in (1.0, 1e-15):
        other = piece_dropout.PieceCodec(tokenizer_path(piece_dropout.PIECE_BPE), rate)
        assert other.decode(other.encode("nation " * 30 + "the" * 40 + " a▁b", 3)) == "nation " * 30 + "the" * 40 + " a▁b"


def test_pieces_through_spark(docs):
    model = tokenizer_path(piece_dropout.PIECE_BPE)
    encoded = piece_dropout.encode_documents(docs, model)
    back = piece_dropout.decode_documents(encoded, model)
    assert Counter(map(tuple, back.collect())) == Counter((r.doc_id, r.text or "") for r in docs.collect())
    assert all(r.lossless for r in piece_dropout.round_trip(docs, model).collect())


def test_round_trip_of_nothing(empty):
    model = tokenizer_path(piece_dropout.PIECE_BPE)
    assert piece_dropout.round_trip(empty, model).count() == 0
    assert piece_dropout.decode_documents(piece_dropout.encode_documents(empty, model), model).count() == 0


# quality


def test_quality_learns_held_out_rows(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        good = rng.random() < 0.6
        words = [rng.choice(["er", "tion", "an"]) * rng.randint(1, 3) for _ in range(rng.randint(5, 80))]
        rows.append((i, " ".join(words) + "." if good else " ".join(w + "%%" if rng.random() < 0.6 else w for w in words)))
        labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), max_rows=500)
    got = quality.score_documents(docs, model).collect()
    assert {r.doc_id: r.held_out for r in got} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _ in rows}
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == labels[r.doc_id][1] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_quality_on_the_driver_s_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    scored = quality.score_documents(documents, quality.train(documents, labels)).join(labels, "doc_id").filter("held_out AND quality IN (0, 1)").collect()
    good, bad = ([r.score for r in scored if r.quality == q] for q in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert len(scored) > 200 and auc > 0.95
    assert np.mean([r.predicted == r.quality for r in scored]) > 0.9


def test_repeated_ids_in_labels_and_documents(spark):
    """Each label of an id counts with each of its rows, in whatever order they come."""
    rows = [(k, f"word {k} " * (k % 7 + 1)) for k in range(60)] + [(3, "other text"), (3, "other text")]
    labels = [(k, k % 2, 0) for k in range(60)] + [(3, 0, 0), (3, 1, 0)]
    models = []
    for turn in (1, -1):
        docs = spark.createDataFrame(rows[::turn], "doc_id long, text string").repartition(3)
        models.append(quality.train(docs, spark.createDataFrame(labels[::turn], "doc_id long, quality int, toxic int").repartition(2)))
    x = np.array([quality.features(t) for _, t in rows])
    assert (models[0].score(x) == models[1].score(x)).all() and quality.score_documents(docs, models[0]).count() == len(rows)


def test_quality_without_labels_or_texts(spark, docs, texts):
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (10**9, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    assert quality.score_documents(docs, model).count() == len(texts)
    assert quality.accepted(docs, model).columns == docs.columns


# near duplicates


def brute_components(texts, k, percent):
    sets = [frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w := words_of(t or "")) >= k else frozenset([tuple(w)] if w else []) for _, t in texts]
    parent = {d: d for d, _ in texts if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(texts):
        for j, (b, _) in enumerate(texts[:i]):
            if None not in (a, b) and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return Counter((d, len(s), None if d is None else find(d)) for (d, _), s in zip(texts, sets, strict=True))


@pytest.mark.parametrize(("k", "percent", "bands", "rows", "block"), [(3, 85, 42, 6, 20_000), (5, 80, 42, 6, 20_000), (3, 85, 42, 6, 400), (3, 85, 32, 8, 20_000)])
def test_near_components(docs, texts, k, percent, bands, rows, block):
    rules = near_dedup.NearRules(shingle=k, percent=percent, bands=bands, rows=rows, least_block=block, most_block=block)
    rows = near_dedup.near_components(docs, rules).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows) == brute_components(texts, k, percent)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in rows)


def test_linked_sets_match_all_pairs():
    rng = np.random.default_rng(12)
    for percent in (50, 80, 85, 100):
        kinds = [np.unique(rng.integers(0, 400, n).astype(np.uint64)) for n in (1, 5, 60, 90)]
        sets = [np.unique(np.concatenate([kinds[rng.integers(4)][: rng.integers(1, 90)], rng.integers(0, 2**63, rng.integers(0, 9)).astype(np.uint64)])) for _ in range(150)]
        want, full = list(range(len(sets))), [set(s.tolist()) for s in sets]
        for i, a in enumerate(full):
            for j in range(i):
                if 100 * len(a & full[j]) >= percent * len(a | full[j]):
                    old, new = max(want[i], want[j]), min(want[i], want[j])
                    want = [new if w == old else w for w in want]
        assert near_dedup.linked(sets, percent).tolist() == want


def test_rules_beyond_a_signature_are_refused():
    with pytest.raises(ValueError):
        near_dedup.NearRules(bands=43, rows=6)


def test_query_s_rules_find_what_an_exact_search_finds(spark):
    """All pairs of the smallest table's texts by a join on shingles, with the registered query's own parameters."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = brute_components([(r.doc_id, r.text) for r in rows], 3, 85)
    found = queries.op9_near_dedup(spark, "/root/testdata/sf0.001").collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == want


def test_near_duplicates_go(docs, texts):
    want = {d for d, _, c in brute_components(texts, 5, 80) if d == c}
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((d, t) for d, t in texts if d is None or d in want)


def test_near_components_of_nothing(empty):
    assert near_dedup.near_components(empty).count() == 0
    assert near_dedup.drop_near_duplicates(empty).columns == empty.columns


def test_signatures_follow_the_sequential_algorithm():
    rng, m = random.Random(9), 16
    sets = [np.unique(np.array([rng.getrandbits(64) for _ in range(n)], dtype=np.uint64)) for n in (1, 2, 7, 40, 300)]
    got = near_dedup.super_min_hash(sets, m)
    for s, signature in zip(sets, got, strict=True):
        best = [1 << 32] * m
        for x in s:
            p = list(range(m))
            for j in range(m):
                z = int(near_dedup.mix64(np.array([(int(x) + (j + 1) * int(near_dedup.GOLDEN)) % 2**64], dtype=np.uint64))[0])
                k = j + ((z & 0xFFFFFFFF) * (m - j) >> 32)
                p[j], p[k] = p[k], p[j]
                best[p[j]] = min(best[p[j]], j << 24 | z >> 40)
        assert signature.tolist() == best


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(10)
    common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (600, 200, 200))
    x, y = near_dedup.super_min_hash([np.unique(np.concatenate([common, a])), np.unique(np.concatenate([common, b]))], 256)
    assert abs((x == y).mean() - 0.6) < 0.12


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(1, 60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges, shared_folder(spark)).collect()}
    assert got == {**{i: 1 for i in range(2, 61)}, 101: 100}


# archives


def test_zip64_directory_is_followed(tmp_path):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        with z.open(zipfile.ZipInfo("a"), "w", force_zip64=True) as f:
            f.write(b"12345")
        for i in range(70_000):
            z.writestr(zipfile.ZipInfo(f"e{i}"), b"")
    data = out.getvalue()
    reader = zip_archives.ZipReader(lambda at, n: data[at : at + n], len(data))
    assert len(reader.members) == 70_001
    at, n = reader.locate("a")
    assert data[at : at + n] == b"12345"


def test_archives_round_trip(spark):
    big = "x" * 1200
    pages = [(1, "u 1", big), (2, "u", big), (3, None, None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (7, "ü", big + "é"), (7, "u", big + "é"), (None, "u", big), (8, "u", "a\r\n\r\nb" * 300)]
    rows = zip_archives.archive(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows)
    want = Counter()
    for i, _, html in pages:
        data = (html or "").encode()
        newest = max((p for p, _, h in pages if h == html and p is not None), default=None)
        revisit = len(data) >= 1000 and i != newest
        want[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", newest if revisit else None] += 1
    assert got == want


def test_records_are_valid_and_headers_have_no_case():
    record = zip_archives.warc_record("response", "5", "http://a/b", "é\r\n\r\nb".encode(), "d", None, "2024-01-02T03:04:05Z")
    fields, payload, http = zip_archives.parse_record(record)
    assert payload == "é\r\n\r\nb".encode() and http["content-length"] == "7"
    assert {"warc-type", "warc-record-id", "warc-date", "content-length", "content-type", "warc-target-uri"} <= set(fields) and fields["warc-date"] == "2024-01-02T03:04:05Z"
    odd = record.replace(b"Content-Length: ", b"CONTENT-LENGTH:", 1).replace(b"WARC-Type: response", b"warc-TYPE:   response")
    assert zip_archives.parse_record(odd) == (fields, payload, http)
    revisit = zip_archives.parse_record(zip_archives.warc_record("revisit", "5", "http://a", b"x" * 2000, "d", "9", "2024-01-02T03:04:05Z"))
    assert revisit[1] == b"" and revisit[2]["content-length"] == "2000" and revisit[0]["warc-refers-to"] == "<urn:page:9>"
    assert zip_archives.parse_record(b"WARC/1.0\r\nContent-Length: 2\r\n\r\nab\r\n\r\n")[1] == b"ab"


def test_archives_of_nothing_clashing_names_and_a_very_long_page(spark):
    schema = "page_id long, url string, html string, payload int, record_type string, _digest int, _newest int, _n int"
    assert zip_archives.archive(spark.createDataFrame([], schema)).count() == 0
    long = "<p>ü</p>" * 400_000
    rows = zip_archives.archive(spark.createDataFrame([(1, "u", long, 1, "x", 2, 3, 4), (2, "u", long, 1, "x", 2, 3, 4)], schema)).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in rows) == [(1, len(long.encode()), "revisit", 2), (2, len(long.encode()), "response", None)]


def test_packages_are_cut_at_their_size(spark):
    pages = zip_archives.classified(spark.createDataFrame([(i, "u", random.Random(i).randbytes(900).hex()) for i in range(50)], "page_id long, url string, html string").coalesce(1))
    manifest = zip_archives.write_packages(pages, shared_folder(spark), package_bytes=10_000)
    assert manifest.count() > 4 and manifest.agg({"n_records": "sum"}).first()[0] == 50
    assert zip_archives.read_packages(manifest).count() == 50


def test_runs_cross_batches():
    from sedimark.llm._common import runs

    batches = [pa.RecordBatch.from_arrays([pa.array(x)], ["k"]) for x in ([1, 1, 2], [2], [2, 3])]
    assert [t.num_rows for t in runs(iter(batches), ["k"])] == [2, 3, 1]
