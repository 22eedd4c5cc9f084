"""Edge cases and brute-force checks of the training-data operators."""

import base64
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from faultspark.llm import bestfit, components, html_template, langid_kernel, line_edit, preference, simhash_golay, spm_dropout, srs_ann, telephony, warc, work

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, print string, component_id string, length string, at string, id string"
LONG = "The quick brown fox jumps over the lazy dog. " * 4000


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", "x", "x", "x", "x") for i, t in rows], DOCS)


EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (None, "one two three four"), (5, "one"), (6, LONG), (7, "日本語 ▁ \U0001f389 \x00"), (None, None)]


def test_spm_matches_library_without_dropout():
    import sentencepiece

    path = spm_dropout.default_model()
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), spm_dropout.Pieces(path, 0.0)
    for text in ["", "Hello, world.", "  two  spaces\n\n x", "日本語 テスト", "naïve, façade. 12,345", "\t\ttabs", "a.b,c. ,", "trailing  "]:
        assert own.encode(text).tolist() == library.encode(text)


@pytest.mark.parametrize("rate, nodes", [(0.0, 1000), (0.1, 20), (0.1, 10**6), (0.6, 10**6), (1.0, 1000)])
def test_spm_batches_equal_one_agenda_each(monkeypatch, rate, nodes):
    monkeypatch.setattr(spm_dropout, "NODES", nodes)
    monkeypatch.setattr(spm_dropout, "WALKED", 50)
    pieces = spm_dropout.Pieces(spm_dropout.default_model(), rate)
    rng = random.Random(5)
    words = ["the", "internationalization", "unbelievable,", "a.b", "naïve", "日本語", "x" * 40, "  ", "\n", "ab▁c", "12,345.6", "counterrevolutionaries"]
    texts = ["", " ", *(" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(12))]
    keys = [rng.getrandbits(64) for _ in texts]
    for _ in range(2):
        ids, ends = pieces.encode_all(texts, keys)
        for text, key, begin, end in zip(texts, keys, [0, *ends], ends):
            chunks = pieces.chunks(" " + text) if text else []
            own = [spm_dropout.mixed(key ^ (k + 1) * spm_dropout.MIX & spm_dropout.MASK) for k in range(len(chunks))]
            assert ids[begin:end].tolist() == [i for c, k in zip(chunks, own) for i in pieces.segment(c, k)]


def test_spm_every_occurrence_draws_for_itself():
    pieces = spm_dropout.Pieces(spm_dropout.default_model(), 0.1)
    ids, ends = pieces.encode_all([" ".join(["of"] * 20_000), " ".join(["information"] * 20_000)], [1, 2])
    whole = pieces.ranks[" of"][1]
    merges = 20_000 - np.count_nonzero(ids[: ends[0]] == whole)
    assert 0.09 < merges / 20_000 < 0.3  # each of its merges is skipped in a tenth of its places
    kinds = {tuple(pieces.segment(" information", spm_dropout.mixed(2 ^ (k + 1) * spm_dropout.MIX & spm_dropout.MASK))) for k in range(3000)}
    assert len(kinds) > 50


def test_spm_dropout_varies_and_is_lossless(spark):
    out = spm_dropout.encode(docs(spark, EDGE)).collect()
    assert len(out) == len(EDGE) and all(r.lossless for r in out)
    texts = spm_dropout.decode(spark.createDataFrame([(r.doc_id, r.ids) for r in out], "doc_id bigint, ids array<int>")).collect()
    assert sorted(r.text for r in texts) == sorted(t or "" for _, t in EDGE)
    path, text = spm_dropout.default_model(), "unbelievable internationalization of tokenization " * 20
    first, again = (spm_dropout.Pieces(path, 0.3).encode(text, spm_dropout.doc_key(5, 1)) for _ in range(2))
    assert first.tolist() == again.tolist() != spm_dropout.Pieces(path, 0.3).encode(text, spm_dropout.doc_key(6, 1)).tolist()
    assert len(first) > len(spm_dropout.Pieces(path, 0.0).encode(text))
    assert spm_dropout.encode(docs(spark, [])).count() == 0


def test_telephony(spark):
    stored = telephony.store(docs(spark, EDGE))
    out = stored.collect()
    assert sorted(r.n_bytes for r in out) == sorted(len((t or "").encode()) for _, t in EDGE)
    for r in out:
        codec, rate, payload, unit = telephony.read_wav(r.media)
        assert (codec, rate, unit) == ("mulaw", 8000, 1) and len(payload) % 64 == 0 < len(payload) and telephony.read_pcm(r.pcm) == telephony.decode(r.media) and len(r.pcm) == 4 * len(payload)
    told = telephony.features(stored).collect()
    assert len(told) == len(EDGE) and {r.feature for r in told if r.doc_id in (4, 5)} == {next(r.feature for r in told if r.doc_id == 4)}
    assert telephony.features(telephony.store(docs(spark, []))).count() == 0


def test_telephony_codecs():
    assert telephony.mulaw_table()[[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert telephony.alaw_table()[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    rng = np.random.default_rng(0)
    blocks = rng.integers(0, 256, (5, 64), np.uint8)

    def one(block):
        sample, index = int(np.frombuffer(block[:2].tobytes(), "<i2")[0]), min(int(block[2]), 88)
        out = [sample]
        for byte in block[4:]:
            for nibble in (int(byte) & 15, int(byte) >> 4):
                step = telephony.STEPS[index]
                change = (step >> 3) + (step if nibble & 4 else 0) + (step >> 1 if nibble & 2 else 0) + (step >> 2 if nibble & 1 else 0)
                sample = max(-32768, min(32767, sample - change if nibble & 8 else sample + change))
                index = max(0, min(88, index + telephony.INDEX_CHANGE[nibble & 7]))
                out.append(sample)
        return out

    assert telephony.decode_adpcm(blocks).tolist() == [one(b) for b in blocks]
    pcm = np.array([0, 100, -100], np.int16)
    assert telephony.resample(pcm, 8000, 16000).tolist() == [0, 50, 100, 0, -100, -100]
    for n in (0, 1, 2, 3, 10, 11):
        wild = rng.integers(-32768, 32768, n).astype("<i2").tobytes()
        assert telephony.read_pcm(telephony.pack_pcm(wild)) == wild
    for codec in ("mulaw", "alaw", "ima_adpcm"):
        assert telephony.read_wav(telephony.wav_bytes(bytes(128), codec))[2] == bytes(128)
    for unit in (36, 256):
        data = rng.integers(0, 256, 3 * unit + 20, np.uint8)
        want = [x for k in range(0, len(data), unit) for x in one(data[k : k + unit])]
        assert np.frombuffer(telephony.decode(telephony.wav_bytes(data.tobytes(), "ima_adpcm", 8000, unit), 8000), "<i2").tolist() == want
    with pytest.raises(ValueError, match="format 1"):
        telephony.read_wav(telephony.wav_bytes(bytes(64)).replace(b"\x07\x00\x01\x00", b"\x01\x00\x01\x00", 1))
    with pytest.raises(ValueError, match="2 channels"):
        telephony.read_wav(telephony.wav_bytes(bytes(64)).replace(b"\x07\x00\x01\x00", b"\x07\x00\x02\x00", 1))


def test_telephony_query_equals_brute_force(spark, tmp_path):
    docs(spark, EDGE).write.parquet(f"{tmp_path}/documents.parquet")
    out = telephony.op2_telephony(spark, str(tmp_path)).collect()
    assert len(out) == len(EDGE)
    of = {}
    for i, text in EDGE:
        data = (text or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        mulaw, alaw = ([int(t[b]) for b in payload] for t in (telephony.mulaw_table(), telephony.alaw_table()))
        high = [x for a, b in zip(mulaw, [*mulaw[1:], mulaw[-1]]) for x in (a, a + b >> 1)]
        adpcm = telephony.decode_adpcm(np.frombuffer(payload, np.uint8).reshape(-1, 64)).ravel().tolist()
        rms = [int((sum(x * x for x in y) / len(y)) ** 0.5) for y in (mulaw, alaw, adpcm)]
        crossings = sum((a < 0) != (b < 0) for a, b in zip(mulaw, mulaw[1:]))
        crc = zlib.crc32(np.asarray(high, "<i2").tobytes())
        media = telephony.wav_bytes(payload)
        feature = f"mulaw_rms={rms[0]};crossings={crossings};alaw_rms={rms[1]};adpcm_rms={rms[2]};pcm_samples={len(high)};pcm_crc32={crc}"
        of.setdefault(i, []).append((i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
    assert sorted(map(str, (tuple(r) for r in out))) == sorted(str(r) for rows in of.values() for r in rows)


def brute_groups(prints):
    """Smallest doc_id reachable through fingerprints that differ in at most two bits."""
    ids = list(range(len(prints)))
    root = ids[:]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(ids, 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            root[find(j)] = find(i)
    return [find(i) for i in ids]


@pytest.mark.parametrize("limit", [0, 1, 64])
def test_simhash_links_equal_brute_force(spark, limit):
    rng = random.Random(limit)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(140):
        p = rng.choice(prints)
        for _ in range(rng.randint(0, 3)):
            p ^= 1 << rng.randrange(64)
        prints.append(p)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash_golay.links(spark.createDataFrame([(p,) for p in signed], "print bigint"), limit)
    roots = {r.node: r.root for r in components.components(edges).collect()}
    found, want = [roots.get(p, p) for p in signed], brute_groups(prints)
    assert all((found[i] == found[j]) == (want[i] == want[j]) for i, j in itertools.combinations(range(len(prints)), 2))


def test_simhash_edges(spark):
    out = simhash_golay.near_groups(docs(spark, [*EDGE, (9, "ONE"), (10, "Zero\x0bone\ttwo")])).collect()
    of = {r.doc_id: r for r in out}
    assert len(out) == len(EDGE) + 2 and of[1].print == of[2].print == of[3].print == 0
    assert of[1].component_id == of[3].component_id == 1 and of[9].component_id == of[4].component_id == 4
    import xxhash

    h = [xxhash.xxh64_intdigest(s, 42) for s in ("a b c", "b c d")]
    assert simhash_golay.fingerprint(b"A  b\nc D") == sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) > 1)
    assert simhash_golay.fingerprint(b"One two") == xxhash.xxh64_intdigest("one two", 42)
    assert simhash_golay.near_groups(docs(spark, [])).count() == 0


PAGES = "page_id bigint, url string, html string, text string, key string, size string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "x", "x") for i, u, h in rows], PAGES)


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "same"), (2, "http://b/\n", "same"), (3, None, None), (4, "u", ""), (None, "n", "same"), (5, "big", "x\x1f\x8b\x08" * 50000), (5, "big", "x\x1f\x8b\x08" * 50000)]
    path = work.new_path(spark, "test-warc")
    warc.archive(pages(spark, rows), path)
    whole = warc.read_warc(spark, path).collect()
    parts = warc.read_warc(spark, path, split_bytes=101).collect()
    assert sorted(map(str, whole)) == sorted(map(str, parts)) and len(whole) == len(rows)
    of = {r.record_id: r for r in whole}
    assert of["<urn:x-page:1>"].record_type == "revisit" and of["<urn:x-page:1>"].refers_to == "<urn:x-page:2>" and of["<urn:x-page:1>"].payload_bytes == 4
    assert of["<urn:x-page:3>"].refers_to == "<urn:x-page:4>" and of["<urn:x-page:4>"].payload_bytes == 0
    assert of["<urn:x-page:2>"].payload_digest == base64.b32encode(hashlib.sha1(b"same").digest()).decode()
    assert of["<urn:x-page:>"].record_type == "response" and len(of["<urn:x-page:5>"].payload) == 250000
    path = work.new_path(spark, "test-warc")
    warc.archive(pages(spark, []), path)
    assert warc.read_warc(spark, path).count() == 0
    path = work.new_path(spark, "test-warc")
    warc.archive(pages(spark, rows), path, min_payload=1)
    assert sum(r.record_type == "revisit" for r in warc.read_warc(spark, path).collect()) == 1


def archive_bytes(rows):
    parts = [warc.member(warc.record(i, "u", payload, None)) for i, payload in rows]
    return parts, np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def read_bytes(spark, data, tmp_path, split, damaged="keep"):
    folder = tmp_path / f"w{len(list(tmp_path.iterdir()))}"
    folder.mkdir()
    (folder / "part.warc.gz").write_bytes(data)
    return sorted((r.offset, r.record_type) for r in warc.read_warc(spark, f"file://{folder}", split, damaged=damaged).collect())


def test_warc_damage_is_reported(spark, tmp_path):
    rng = random.Random(2)
    parts, at = archive_bytes([(i, bytes(rng.choices(b"abcdefgh <>\n", k=400 + 60 * i))) for i in range(8)])
    whole, good = b"".join(parts), [(int(a), "response") for a in at[:-1]]
    for split in (1 << 20, 300, 37):
        assert read_bytes(spark, whole, tmp_path, split) == good
        assert read_bytes(spark, whole[:-20], tmp_path, split) == [*good[:-1], (good[-1][0], "damaged")]
        for k in (0, 3, 7):
            for place in (at[k] + 2, at[k] + 40, at[k + 1] - 30, at[k + 1] - 6):
                hurt = bytearray(whole)
                hurt[place] ^= 0x55
                got = read_bytes(spark, bytes(hurt), tmp_path, split)
                assert [g for g in got if g[1] == "response"] == [g for j, g in enumerate(good) if j != k]
                assert ("damaged" in {g[1] for g in got}) and all(at[k] <= g[0] < at[k + 1] for g in got if g[1] == "damaged")
    with pytest.raises(Exception, match="damaged at byte"):
        read_bytes(spark, whole[:-20], tmp_path, 300, "raise")
    made = warc.record(1, "u", b"x", None)
    for was, now in ((b"Content-Length: ", b"Content-Length: q"), (b"\r\n\r\nx", b"\r\n\r\ny")):
        assert read_bytes(spark, warc.member(made.replace(was, now)), tmp_path, 100) == [(0, "damaged")]


def test_html_text(spark):
    page = "<html><head><title>T</title><script>x='</p>'</script></head><body><nav><a>m</a></nav><div class='ad'>buy</div><article><h1>A &amp; B</h1><p>One <b>two</b><br>three&nbsp;four<p>x &lt;y&gt;<div class=comments>no</div></article><aside>s</aside><footer>f</footer>"
    assert html_template.Page(page).text(lambda d: False) == "A & B\nOne two three four\nx <y>"
    rows = [(1, "http://h/1", page), (2, None, None), (3, "bad", "<p unclosed 'quote"), (None, "http://h/2", "<p>x"), (1, "http://h/1", page)]
    out = html_template.extract(pages(spark, rows)).collect()
    assert len(out) == 5 and sorted(r.text for r in out)[-1] == "x" and all(r.n_chars == len(r.text) for r in out)
    assert html_template.extract(pages(spark, [])).count() == 0


@pytest.mark.parametrize("broadcast_rows", [-1, 1000])
def test_site_templates_are_removed(spark, broadcast_rows):
    shared = "<div><div><span>Our site</span> is best</div></div>"
    rows = [(i, f"http://h.org/{i}", f"<body>{shared}<div><p>Text {i}</div></body>") for i in range(8)]
    rows += [(100 + i, "http://copies.org/", "<body><div><p>Whole copy</div></body>") for i in range(20)]
    out = {r.page_id: r.text for r in html_template.extract(pages(spark, rows), broadcast_rows=broadcast_rows).collect()}
    assert [out[i] for i in range(8)] == [f"Text {i}" for i in range(8)] and out[105] == "Whole copy"


TURNS = "struct<role:string,text:string>"


def test_preference(spark):
    rows = [
        (1, [("user", "hi"), ("assistant", "a"), ("user", "q"), ("assistant", "yes")], [("user", "hi"), ("assistant", "a"), ("user", "q"), ("assistant", "no<|end|>")], "x"),
        (2, None, [("user", None)], "x"),
        (3, [("user", "same")], [("user", "same")], "x"),
        (4, [], [], "x"),
    ]
    table = spark.createDataFrame(rows, f"id int, chosen array<{TURNS}>, rejected array<{TURNS}>, prompt string")
    out = {r.id: r for r in preference.format_pairs(table).collect()}
    r = out[1]
    assert r.n_common == 3 and r.prompt == "<|user|>\nhi<|end|>\n<|assistant|>\na<|end|>\n<|user|>\nq<|end|>\n"
    assert r.chosen_completion == "<|assistant|>\nyes<|end|>\n" and r.rejected_completion == "<|assistant|>\nno< |end|><|end|>\n"
    (start, length), = r.chosen_mask
    assert r.chosen_completion[start : start + length] == "yes<|end|>\n"
    assert out[2].n_common == 0 and out[2].rejected_mask == [] and out[3].n_common == 1 and out[3].chosen_completion == "" and out[4].prompt == ""
    turns = spark.createDataFrame([(0, 0, "user", "u"), (0, 1, "assistant", "a"), (1, 0, "user", "v"), (None, 0, "user", None), (2, 1, "assistant", "z"), (2, 1, "assistant", "z"), (2, 0, None, None)], "conv_id bigint, turn bigint, role string, text string")
    pairs = {r.conv_id: r for r in preference.reply_pairs(turns).collect()}
    assert len(pairs) == 4 and pairs[0].chosen == pairs[0].rejected[:1] + pairs[0].chosen[1:] and pairs[0].rejected[1].text == ""
    assert preference.format_pairs(preference.reply_pairs(turns.limit(0))).count() == 0


def test_language_id(spark):
    words = {"en": "the of and to in that with this from which", "de": "der die und in den von zu das mit sich", "fr": "le la les et des une que dans pour qui"}
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(words[x].split()) for _ in range(30)), x) for i in range(300) for x in [list(words)[i % 3]]]
    extra = [(1000, None, "en"), (1001, "", "de"), (1002, "123 !?", "fr"), (None, "the of and", None), (1003, LONG, None)]
    table = spark.createDataFrame([(i, t, x, "clash") for i, t, x in rows + extra], "doc_id bigint, text string, lang string, score string")
    out = langid_kernel.predict(table, langid_kernel.fit(table)).collect()
    told = {r.doc_id: r for r in out}
    held = [(i, x) for i, _, x in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([told[i].lang_pred == x for i, x in held]) > 0.95 and all(0 <= r.score <= 1 for r in out)
    assert told[1000].lang_pred == told[1001].lang_pred == told[1002].lang_pred == "und" and told[1003].lang_pred == "en"
    carried = langid_kernel.predict(table, langid_kernel.fit(table), carry=True)
    assert carried.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    empty = table.limit(0)
    assert langid_kernel.fit(empty) is None and langid_kernel.predict(empty, None).count() == 0
    assert {r.lang_pred for r in langid_kernel.predict(table.limit(3), None).collect()} == {"und"}


SCRIPTS = {"en": "the of and that with", "ru": "и в не на что он был", "uk": "і в не на що він був", "el": "και το να είναι από", "hi": "है और के में की से", "zh": "的一是不了人我在有他", "ja": "のにはをたがでてとし", "ar": "في من على أن إلى"}


def test_language_id_of_scripts_and_exact_kernels(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(SCRIPTS[x].split()) if " " in SCRIPTS[x] else "".join(rng.choices(SCRIPTS[x], k=4)) for _ in range(25)), x) for i in range(480) for x in [list(SCRIPTS)[i % 8]]]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid_kernel.fit(table)
    told = {r.doc_id: r for r in langid_kernel.predict(table, model).collect()}
    held = [(i, x) for i, _, x in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([told[i].lang_pred == x for i, x in held]) > 0.97

    def brute(text):
        import unicodedata

        signs = [c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower()]
        return {tuple(signs[k : k + n]) for n in (1, 2, 3) for k in range(len(signs) - n + 1)}

    texts = [rows[k][1] for k in range(16)] + ["A-b c!", "é", "1 2", "x" * 50]
    spectrum = langid_kernel.Spectrum(model.grams)
    for a in texts:
        present, size = spectrum.presence(a)
        assert size == len(brute(a)) == len(langid_kernel.grams(a))
        assert (model.grams[present] == np.intersect1d(model.grams, langid_kernel.grams(a))).all()
        for b in texts:
            assert len(np.intersect1d(langid_kernel.grams(a), langid_kernel.grams(b))) == len(brute(a) & brute(b))
    assert langid_kernel.fit(table, most_grams=1) is None


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 16)) * 3
    rows = [(i, (centres[i % 12] + rng.standard_normal(16)).tolist()) for i in range(1500)]
    rows += [(2000 + i, [1.0] * 16) for i in range(40)]
    bad = [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [1.0, None] * 8), (5400, [1.0]), (None, [2.0] * 16), (5500, [float("inf")] * 16), (5600, [])]
    table = spark.createDataFrame([(i, v, "x", "x") for i, v in rows + bad], "vec_id bigint, embedding array<double>, a string, rank string")
    out = srs_ann.nearest(table, every=50).collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    hit = 0
    for q in [i for i in ids if i % 50 == 0]:
        far = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        want = [int(ids[k]) for k in np.lexsort((ids, far)) if ids[k] != q][:10]
        got = sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == q)
        assert [g[0] for g in got] == list(range(1, 11)) and all(abs(far[ids == v][0] - s) < 1e-9 for _, v, s in got)
        hit += len(set(want) & {g[1] for g in got}) / 10
        if q == 2000:
            assert [g[1] for g in got] == list(range(2001, 2011))
    assert hit / len({r.query_id for r in out}) >= 0.9
    few = srs_ann.nearest(table.where("vec_id in (0, 7, 9)"), every=50).collect()
    assert sorted(r.vec_id for r in few) == [7, 9]
    assert srs_ann.nearest(table.limit(0)).count() == 0 and srs_ann.nearest(table.where("vec_id = 0")).count() == 0


@pytest.mark.parametrize("part, block", [(16_384, 4096), (150, 3)])
def test_neighbours_of_repeated_rows_and_split_cells(spark, monkeypatch, part, block):
    monkeypatch.setattr(srs_ann, "PART", part)
    monkeypatch.setattr(srs_ann, "BLOCK", block)
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(300)]
    rows += [rows[0], rows[0], rows[7], (100, [9.0] * 8), *((200, [0.1 * k, *rows[200][1][1:]]) for k in range(30))]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    out = srs_ann.nearest(table, every=20, sure=0.9999).toPandas()
    x = {i: [np.array(v) for j, v in {(j, tuple(v)) for j, v in rows} if j == i] for i, _ in rows}
    for q, got in out.sort_values("rank").groupby("query_id"):
        assert got["rank"].tolist() == list(range(1, 11)) and q not in set(got.vec_id)
        wants = [sorted((float(np.sqrt(((v - own) ** 2).sum())), i) for i, vs in x.items() if i != q for v in vs)[:10] for own in x[q]]
        assert any([w[1] for w in want] == got.vec_id.tolist() and np.allclose([w[0] for w in want], got.score) for want in wants)
    assert set(out.query_id) == {i for i, _ in rows if i % 20 == 0}


def test_packing(spark):
    out = bestfit.pack_documents(docs(spark, EDGE), keep_ids=True).toPandas()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bestfit.default_tokenizer())
    want = [np.asarray([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for _, t in EDGE]
    pieces = sorted((len(w[a : a + 2048]), zlib.crc32(w[a : a + 2048].tobytes())) for w in want for a in range(0, len(w), 2048))
    assert sorted(zip(out.length, out.ids_crc32)) == pieces
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == np.concatenate([[0], np.cumsum(s.length)[:-1]]).tolist() and s.length.sum() <= 2048
    assert bestfit.pack_documents(docs(spark, [])).count() == 0


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        if fits := [g for g in gaps if g >= n]:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("low, high, many", [(1, 100, 800), (30, 45, 400), (100, 100, 7), (1, 3, 500), (34, 60, 300)])
def test_supersteps_place_all_ranks_as_well_as_best_fit(spark, low, high, many):
    rng = random.Random(9)
    lengths = [rng.randint(low, high) for _ in range(many)]
    pieces = spark.createDataFrame([(k % 50, k, n) for k, n in enumerate(lengths)], "doc_id bigint, piece int, length bigint")
    out = bestfit.pack(pieces, 100).toPandas()
    assert sorted(out.piece) == list(range(many)) and sorted(out.length) == sorted(lengths)
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == np.concatenate([[0], np.cumsum(s.length)[:-1]]).tolist() and s.length.sum() <= 100
    assert out.sequence_id.nunique() <= best_fit_decreasing(lengths, 100) * 1.01 + 0.5


def test_sweep_takes_the_least_gap_by_rank():
    matches, left, gaps, after = bestfit.sweep([(40, 0, 3), (30, 5, 1), (90, 0, 1)], [(50, 7, 1), (85, 3, 1), (35, 9, 1)], 100)
    assert matches == [(40, 0, 1, 7, 1, 50), (40, 1, 3, 3, 2, 15), (30, 5, 6, 9, 1, 65)]
    assert left == [(90, 0, 1)] and gaps == [] and sorted(after) == [(5, 3, 1), (5, 9, 1), (10, 7, 1)]


@pytest.mark.parametrize("most", [0, 5, 1000])
def test_chunk_table_equals_the_tokenizer(most):
    import pyarrow as pa

    cache = bestfit.WordCache(bestfit.default_tokenizer(), most)
    rng = random.Random(1)
    signs = "aB é.,|'s1 2\n\t\xa0ñÀß²_-<日本\u0301 K·"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["", "<|endoftext|> x", "a|b | c", "don't. it's, I'LL", "\u0301a \u0301"]
    for part in (texts, texts[::-1], texts[:50]):
        ids, ends = cache.encode(pa.array(part))
        for text, begin, end in zip(part, [0, *ends], ends):
            assert ids[begin:end].tolist() == cache.tokenizer.encode(text, add_special_tokens=False).ids


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("limit", [1, 48])
def test_line_dedup_equals_brute_force(spark, limit):
    rng = random.Random(limit)
    letters = "abcdé fgh"
    lines = ["".join(rng.choice(letters) for _ in range(rng.randint(20, 60))).strip() for _ in range(40)]
    for _ in range(160):
        line = list(rng.choice(lines))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(line))
            line[k : k + rng.randint(0, 1)] = rng.choice(["", "x", letters[0]])
        lines.append("".join(line).strip())
    rng.shuffle(lines)
    rows = [(i, "\n".join([*lines[6 * i : 6 * i + 6], "short", ""])) for i in range(len(lines) // 6)]
    rows += [(900, None), (901, ""), (902, "short\nshort"), (None, lines[0]), (903, " " + lines[3] + " ")]
    out = {r.doc_id: r for r in line_edit.dedup_lines(docs(spark, rows), limit).collect()}
    placed = sorted(((i if i is not None else 1 << 63, k), line.strip(" ")) for i, t in rows for k, line in enumerate((t or "").split("\n")))
    seen, dropped = [], set()
    for place, line in placed:
        if len(line) >= line_edit.MIN_CHARS:
            if any(line == x or abs(len(line) - len(x)) <= 2 and edits(line, x) <= 2 for x in seen):
                dropped.add(place)
            seen.append(line)
    for i, t in rows:
        kept = None if t is None else "\n".join(line for k, line in enumerate(t.split("\n")) if (i if i is not None else 1 << 63, k) not in dropped)
        assert out[i].text == kept and out[i].print == "x"
        assert out[i]._n_equal + out[i]._n_near == sum(p[0] == (i if i is not None else 1 << 63) for p in dropped)
    assert line_edit.dedup_lines(docs(spark, [])).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    own = [" ".join(rng.sample("alpha bravo carol delta eager fancy green hotel india jolly kilos limit mango north".split(), 9)) for _ in range(40)]
    rows = [(i, f"The words {own[i]} are of this one and it ends here.\nA line that all of the documents hold in common.", "en", "s", 1) for i in range(40)]
    rows += [(100, "123", "en", "s", 3), (101, None, "en", "s", None), (102, rows[0][1], "en", "s", 1), (103, rows[1][1].replace("ends", "endz"), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    given = work.read(spark, str(tmp_path), "documents")
    kept = corpus_pipeline.language_id(spark, given, str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == set(range(40)) | {102, 103} and kept.columns == given.columns
    lines = corpus_pipeline.line_dedup(spark, work.cut(kept), str(tmp_path))
    held = {r.doc_id: r for r in lines.collect()}
    assert set(held) == set(range(40)) and "common" in held[0].text and "common" not in held[1].text and held[1].n_chars == len(held[1].text)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} <= set(range(40)) and packed
