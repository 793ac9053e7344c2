"""Secret spans, benchmark phrases, token files and archives against plain Python over whole texts."""

import hashlib
import json
import random
import re
import struct
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from tests.llm import samples
from tidemark.llm import fm_index, queries, rans, secrets, warc
from tidemark.session import new_folder


def base_by_hand(text):
    found = []
    pattern = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(pattern, text):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, m.end(), "assign"))
    for k, name, p, least in ((1, "access", r"AKIA[A-Z0-9]+", 18), (2, "hex", r"[0-9a-f]+", 16)):
        found += [(m.start(), k, m.end(), name) for m in re.finditer(p, text) if len(m[0]) >= least]
    return [f"{n}:{a}:{b}" for a, _, b, n in sorted(found)]


def test_secrets_match_plain_search(spark):
    docs = samples.documents(spark)
    models = secrets.fit(secrets.counts_from_rules(docs))
    got = secrets.find_secrets(docs, models).collect()
    lists = [(r["id"], [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] if s["kind"] != "markov"]) for r in got]
    assert samples.multiset(lists) == samples.multiset((i, base_by_hand(t or "")) for i, t in samples.pairs(docs))
    assert any("access" in x for _, s in lists for x in s) and any("assign" in x for _, s in lists for x in s)
    extra = [(r["id"], s) for r in got for s in r["spans"] if s["kind"] == "markov"]
    assert 1015 in {i for i, _ in extra}  # the random string that no rule names
    assert secrets.find_secrets(samples.empty(spark), models).count() == 0


def test_models_tell_random_from_ordinary_on_held_out_strings(spark):
    rng = np.random.default_rng(3)
    letters = np.frombuffer(secrets.LETTERS, np.uint8)
    random = [rng.choice(letters[:62], 24).tobytes().decode() for _ in range(400)]
    stems = ["customer", "order", "total", "index", "value", "report", "delete", "update", "handler", "request", "session", "config"]
    ordinary = ["_".join(rng.choice(stems, 4)) for _ in range(400)]
    rows = [(t, 1) for t in random[:300]] + [(t, 0) for t in ordinary[:300]] + [(None, 1), ("", 0), ("x", None)]
    models = secrets.fit(secrets.labelled_counts(spark.createDataFrame(rows, "text string, label int"), "text", "label"))
    right = sum(models.score(t.encode()) >= secrets.LEAST_RATIO for t in random[300:]) + sum(models.score(t.encode()) < secrets.LEAST_RATIO for t in ordinary[300:])
    assert right >= 195


def trained():
    rng = np.random.default_rng(8)
    letters = np.frombuffer(secrets.LETTERS, np.uint8)
    token = lambda n: rng.choice(letters[:62], n).tobytes().decode()
    stems = ["customer", "order", "total", "index", "value", "report", "delete", "update", "handler", "request", "session", "config", "services", "hooks", "host"]
    name = lambda n: "".join(w + rng.choice(["/", "=", "."], p=[0.8, 0.1, 0.1]) for w in rng.choice(stems, n))[:-1]
    counts = [sum(np.bincount(secrets.pairs(t.encode()), minlength=secrets.N**2) for t in ts) for ts in ([token(24) for _ in range(400)], [name(6) for _ in range(2000)])]
    return secrets.Models(*counts), token, name


def test_best_stretch_equals_all_stretches_tried():
    rng = np.random.default_rng(1)
    for n in [*range(1, 12), 60]:
        gain = rng.normal(-0.2, 1, n).round(2)
        start, end, total = secrets.best_stretch(gain)
        assert total == pytest.approx(max(gain[a:b].sum() for a in range(n) for b in range(a + 1, n + 1))) == pytest.approx(gain[start:end].sum())


def test_tokens_next_to_base_spans_and_at_the_end_of_paths_are_found_by_themselves(spark):
    models, token, name = trained()
    a, b, c, d = (token(28) for _ in range(4))
    digits = "0123456789abcdef" * 2
    texts = {
        1: f"see {digits}.{a} there", 2: f"//{name(8)}/{b}", 3: f"{name(5)}/{c}/{name(5)}/{d}", 4: name(200), 5: "", 6: None,
        7: f"über {name(3)}={a}", 8: name(30_000) + "/" + b, 9: f"password={a} {name(4)}",
    }
    docs = spark.createDataFrame([*texts.items(), (2, texts[2])], "doc_id long, text string")
    got = [(r["id"], [texts[r["id"]][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "markov"]) for r in secrets.find_secrets(docs, models).collect()]
    assert sorted(got) == [(1, [a]), (2, [b]), (2, [b]), (3, [c, d]), (4, []), (5, []), (6, []), (7, [a]), (8, [b]), (9, [])]


def test_stretch_errors_on_held_out_strings():
    models, token, name = trained()
    hit = lambda t: bool(models.stretches(t.encode(), [(0, len(t))], secrets.LEAST_RATIO))
    assert sum(hit(name(40)) for _ in range(500)) == 0
    for length, least in ((16, 0.9), (20, 0.98), (24, 0.99)):
        assert sum(hit(name(3) + "/" + token(length)) for _ in range(300)) >= least * 300


def phrases_by_hand(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    windows = {}
    for i, t in items:
        w = word.findall(low(t))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    sizes = {len(k) for k in windows}
    out = []
    for i, t in docs:
        w = word.findall(low(t))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def benchmark(spark):
    given = spark.read.parquet(f"{samples.SF}/benchmark.parquet").select("item_id", "text")
    rows = [(90001, "one two"), (90002, None), (90003, ""), (90004, "W5X5 w6x6 w7x7"), (90005, "one two"), (90006, " ".join(f"w{i % 97}x{i % 13}" for i in range(30, 60)))]
    return given.union(spark.createDataFrame(rows, given.schema))


@pytest.mark.parametrize("block_bytes", [1 << 20, 3000])
def test_phrases_match_plain_search(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(fm_index, "BLOCK_BYTES", block_bytes)
    docs, items = samples.documents(spark), benchmark(spark)
    if block_bytes < 10_000:
        docs = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    docs = docs.cache()
    got = fm_index.judged(fm_index.find_phrases(docs, items, "doc_id", "text")).collect()
    mine = [(r["row"], r["n_words"], r["n_hit"], r["n_items"], hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r["contaminated"]) for r in got]
    want = phrases_by_hand(samples.pairs(docs), [(r[0], r[1]) for r in items.collect()])
    assert samples.multiset(mine) == samples.multiset(want)
    assert sum(r[2] > 0 for r in want) > 3
    assert fm_index.find_phrases(samples.empty(spark), items, "doc_id", "text").count() == 0
    assert fm_index.judged(fm_index.find_phrases(docs, items.limit(0), "doc_id", "text")).where("n_hit > 0").count() == 0


def test_small_shards_give_the_same_spans():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abc"), rng.integers(0, 60))) for _ in range(60)]
    p = fm_index.Phrases([("i", " ".join(rng.choice(list("abc"), 5))), ("j", "a b"), ("k", texts[7])])
    batch = pa.RecordBatch.from_pydict({"row": list(range(60)), "text": texts})
    spread = lambda n: [r for b in fm_index.spans_of(iter([batch]), p, n) for r in b.to_pylist()]
    assert spread(1) == spread(1 << 20) and [r["row"] for r in spread(1)] == list(range(60))


def test_suffix_array_and_locate():
    rng = np.random.default_rng(1)
    s = np.concatenate([rng.integers(0, 4, 400), np.tile([1, 2, 3], 60), np.zeros(30, np.int64)])
    assert fm_index.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    index = fm_index.FMIndex(s, 3)
    low, high = index.search(np.array([[0, 2, 3], [1, 2, 3], [3, 3, 1]]), np.array([2, 3, 3]))
    for k, pattern in enumerate(([2, 3], [1, 2, 3], [3, 3, 1])):
        want = [i for i in range(len(s) - len(pattern) + 1) if s[i : i + len(pattern)].tolist() == pattern]
        assert sorted(index.locate(np.arange(low[k], high[k]))) == want


def tokens_by_hand(docs):
    from tokenizers import Tokenizer

    tok, out, start = Tokenizer.from_file(queries.tokenizer_path()), [], 0
    for i, t in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), start))
        start += len(ids)
    return out, start


def test_token_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(rans, "BLOCK_TOKENS", 20_000)
    docs, path = samples.documents(spark).cache(), new_folder(spark, "tokens")
    rans.write_tokens(docs, path, queries.tokenizer_path())
    got = [(r["key"], len(r["ids"]) // 4, zlib.crc32(r["ids"]), r["start"]) for r in rans.read_tokens(spark, path).collect()]
    want, total = tokens_by_hand(samples.pairs(docs))
    assert samples.multiset(r[:3] for r in got) == samples.multiset(r[:3] for r in want)
    assert sorted(r[3] for r in got)[0] == 0 and max(r[3] + r[1] for r in got) == total
    once = {k for k, n in __import__("collections").Counter(r[0] for r in want).items() if n == 1}
    assert samples.multiset(r for r in got if r[0] in once) == samples.multiset(r for r in want if r[0] in once)


def test_empty_token_file(spark):
    path = new_folder(spark, "tokens")
    rans.write_tokens(samples.empty(spark), path, queries.tokenizer_path())
    assert rans.read_tokens(spark, path).count() == 0


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(queries.tokenizer_path()) as file:
        known = json.load(file)
    with open(path) as file:
        other = json.load(file)
    assert rans.words_stand_alone(known) and not rans.words_stand_alone(other)
    for change in ({"normalizer": None}, {"pre_tokenizer": None}, {"added_tokens": [{"content": "cat", "special": True}]}, {"truncation": {"max_length": 9}}):
        assert not rans.words_stand_alone(known | change)
    texts = ["Two  Words, kept AS they are\n", "", None, "é ß <|endoftext|> x's", "word " * 3000]
    library = Tokenizer.from_file(path)
    want = [i for t in texts for i in [*library.encode(t or "", add_special_tokens=False).ids, 2]]
    parts = list(rans.Encoder(path, 2).batch(pa.array(texts, pa.string())))
    assert np.concatenate([ids for _, ids, _ in parts]).tolist() == want and sum(len(per) for _, _, per in parts) == len(texts)


def test_encoding_holds_little_beside_the_texts():
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(300)) for _ in range(4000)]
    encoder = rans.Encoder(queries.tokenizer_path(), 2)
    tracemalloc.start()
    try:
        parts = [(len(per), int(per.sum()) == len(ids)) for _, ids, per in encoder.batch(pa.array(texts))]
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(n for n, _ in parts) == len(texts) and all(whole for _, whole in parts)
    assert most < 90 << 20  # of 7 MB of texts with 590,000 different words
    assert 4 * rans.BLOCK_TOKENS < 512 << 10  # a row of plain ids is no humongous object of the JVM


@pytest.mark.parametrize("n", [1, 5, 1023, 1024, 1025, 300_000])
def test_blocks_decode_from_checkpoints_and_notice_damage(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n) - 1, 40_000).astype(np.uint32)
    freq = rans.frequency_table(dict(enumerate(np.bincount(ids).tolist())) | {41_000: 1})
    assert freq.sum() == 1 << rans.SCALE
    raw = rans.encode_block(ids, freq, np.array([7]), np.array([True]), np.array([n]))
    block, table = rans.Block(raw), rans.Table(freq)
    assert np.array_equal(block.ids(table), ids)
    assert np.array_equal(np.concatenate([block.ids(table, k) for k in range(len(block.marks))]), ids)
    assert len(block.marks) == max(1, -(-block.rows // rans.CHECKPOINT_ROWS))
    broken = bytearray(raw)
    broken[-1] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        rans.Block(bytes(broken))


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 40_000)
    own = [(5, "http://a/\r\nX: y", "<p>é</p>", "q"), (2, None, "<p>é</p>", "q"), (9, "u", None, None), (4, "u", "", None), (None, "u", "", None), (None, None, None, None), (2, None, "<p>é</p>", "q")]
    given = spark.read.parquet(f"{samples.SF}/pages.parquet").selectExpr("page_id + 100", "url", "html", "'x' AS payload")
    pages = given.union(spark.createDataFrame(own, "a long, url string, html string, payload string")).toDF("page_id", "url", "html", "payload").repartition(3).cache()
    path = new_folder(spark, "warc")
    warc.write_archives(pages, path)
    got = warc.read_archives(spark.read.parquet(path)).collect()
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    first = {}
    for i, p in rows:
        first[p] = min((x for x in (first.get(p), i) if x is not None), default=None)
    want = [(i, len(p), warc.sha1_base32(p), "response" if i == first[p] else "revisit", None if i == first[p] else first[p]) for i, p in rows]
    assert samples.multiset((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == samples.multiset(want)
    assert {r["payload"] for r in got if r["record_type"] == "response"} == {p for _, p in rows}
    empty = new_folder(spark, "warc")
    warc.write_archives(pages.limit(0), empty)
    assert warc.read_archives(spark.read.parquet(empty)).count() == 0


def test_archive_reader_refuses_damage():
    good = [warc.record(i, "http://x", b"<p>%d</p>" % i * 40, None, False) for i in range(30)]
    data = warc.archive(good)
    assert list(warc.frames(data)) == good
    with pytest.raises(ValueError, match="dictionary"):
        list(warc.frames(data[8:]))
    with pytest.raises(ValueError, match="inside a frame"):
        list(warc.frames(data[:-5]))
    for old, new, what in ((b"WARC/1.1", b"WARC/0.9", "1.1"), (b"Content-Length: ", b"Content-Length: 1", "long"), (b"<p>3", b"<p>4", "digest")):
        with pytest.raises(ValueError, match=what):
            warc.parse(good[3].replace(old, new))


def public_record(kind, block, version="1.0", name="a", lines=()):
    head = [f"WARC/{version}", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 2020-01-01T00:00:00Z", *lines, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


HTTP = "Content-Type: application/http; msgtype=response"


def public_records():
    page = b"<p>public</p>" * 30
    chunks = b"5;x=1\r\n<p>pu\r\n" + f"{len(page) - 5:X}".encode() + b"\r\n" + page[5:] + b"\r\n0\r\n\r\n"
    answer = b"HTTP/1.1 200 OK\r\nX-A: 1\r\nX-A: 2\r\n"
    md5 = hashlib.md5(page).hexdigest()
    uri = "WARC-Target-URI: http://x/"
    return page, [
        public_record("warcinfo", b"software: some\r\nformat: WARC\r\n", name="i", lines=["Content-Type: application/warc-fields"]),
        public_record("request", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", name="q", lines=["Content-Type: application/http; msgtype=request", uri, "WARC-Concurrent-To: <urn:uuid:r>", "WARC-Concurrent-To: <urn:uuid:m>"]),
        public_record("response", answer + b"\r\n" + page, name="r", lines=[HTTP, uri, f"WARC-Payload-Digest: md5:{md5}"]),
        public_record("response", answer + b"Transfer-Encoding: chunked\r\n\r\n" + chunks, "1.1", "c", [HTTP, uri, f"WARC-Payload-Digest: sha1:{warc.sha1_base32(chunks)}"]),
        public_record("response", answer + b"Transfer-Encoding: chunked\r\n\r\n" + chunks, "1.1", "d", [HTTP, uri, f"WARC-Payload-Digest: sha-256:{hashlib.sha256(page).hexdigest()}"]),
        public_record("response", answer + b"Content-Length: 999\r\n\r\n" + page, name="t", lines=[HTTP, uri, "WARC-Truncated: length", "WARC-Payload-Digest: sha1:AAAA"]),
        public_record("revisit", answer + b"\r\n", name="v", lines=[HTTP, uri, "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/server-not-modified", "WARC-Refers-To: <urn:uuid:r>", "WARC-Payload-Digest: sha1:QQ"]),
        public_record("revisit", b"", name="w", lines=[uri, "WARC-Payload-Digest: blake3:00"]),
        public_record("metadata", b"a: b\r\n", name="m", lines=["Content-Type: application/warc-fields", "X-Folded: one", "\ttwo", "WARC-Block-Digest: blake3:unknown"]),
        public_record("resource", "é".encode(), name="s", lines=["Content-Type: text/plain", "WARC-Target-URI: file:///s"])]


@pytest.mark.parametrize("dictionary", [True, False])
def test_public_archive_files_are_read(spark, tmp_path, dictionary):
    page, records = public_records()
    if dictionary:
        data = warc.archive(records)
    else:  # plain frames with another skippable one between them
        small = [zstandard.ZstdCompressor().compress(r) for r in records]
        data = b"".join(small[:3]) + struct.pack("<II", 0x184D2A50, 3) + b"abc" + b"".join(small[3:])
    (tmp_path / "a.warc.zst").write_bytes(data)
    (tmp_path / "empty.warc.zst").write_bytes(b"")
    got = {r["record_id"][10:-1]: r for r in warc.read_files(spark, str(tmp_path / "*.warc.zst")).collect()}
    kinds = {"i": "warcinfo", "q": "request", "r": "response", "c": "response", "d": "response", "t": "response", "v": "revisit", "w": "revisit", "m": "metadata", "s": "resource"}
    assert {k: r["record_type"] for k, r in got.items()} == kinds and {r["page_id"] for r in got.values()} == {None}
    for k in "rcdt":
        assert (bytes(got[k]["payload"]), got[k]["payload_bytes"], got[k]["payload_digest"]) == (page, len(page), warc.sha1_base32(page))
    assert (got["v"]["payload"], got["v"]["payload_bytes"], got["v"]["payload_digest"], got["v"]["refers_to_id"]) == (None, None, "QQ", "<urn:uuid:r>")
    assert bytes(got["s"]["payload"]) == "é".encode() and got["q"]["payload_bytes"] == 0 and bytes(got["m"]["payload"]) == b"a: b\r\n"


def test_public_dialects_are_checked_all_the_same():
    _, records = public_records()
    response, resource = records[2], records[9]
    for bad, what in (
        (response.replace(b"public", b"publik", 1), "digest"), (response.replace(b"X-A: 1", b"Content-Length: 7"), "long|length"),
        (resource.replace(b"WARC-Type: resource", b"WARC-Type: resource\r\nWARC-Type: response"), "contradicts"),
        (resource.replace(b"WARC-Record-ID: <urn:uuid:s>\r\n", b""), "record-id"), (resource.replace(b"Content-Type: text/plain", b"no colon"), "header line"),
        (resource.replace(b"Content-Length: 2", b"Content-Length: -2"), "proper length"),
        (resource.replace(b"Content-Type: text/plain", b"WARC-Block-Digest: sha1:!!"), "block digest")):
        with pytest.raises(ValueError, match=what):
            warc.parse(bad)


def test_many_frames_and_one_larger_than_a_step():
    rng = np.random.default_rng(2)
    records = [warc.record(i, "u", rng.bytes(n), None, False) for i, n in enumerate([0, 10, 3 * warc.STEP, 1, warc.STEP, *[300] * 400])]
    assert list(warc.frames(warc.archive(records))) == records
