"""Operators on small fixtures against brute force: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.llm import audio, bwt_dedup, cover_dedup, decontaminate, html_text, langid, pii, piece_bpe, queries, repeats, simhash, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, parts=5):
    """Extra columns clash with names that the operators use inside."""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return df.withColumns({c: F.lit("x") for c in ("fp", "d", "k", "tag", "spans", "rid", "start", "end", "key", "component_id", "payload")})


def noise(rnd, n, letters="klmnö pq"):
    return "".join(rnd.choice(letters) for _ in range(n))


def planted(seed):
    """Odd texts, shared passages, copies and near copies."""
    rnd = random.Random(seed)
    base = " ".join(f"w{rnd.randrange(40 if seed % 2 else 4000)}" for _ in range(500))
    out = [None, "", " ", "\n\t", "a", "a b", "x " * 700, "é" * 450]
    for _ in range(70):
        t = " ".join(f"u{rnd.randrange(3000)}" for _ in range(rnd.randrange(80)))
        for _ in range(rnd.randrange(3)):
            at, cut = rnd.randrange(len(t) + 1), rnd.randrange(len(base))
            t = t[:at] + " " + base[cut : cut + rnd.randrange(50, 700)] + t[at:]
        out.append(t)
    near = base.split()
    for i in range(40):  # many near copies of one text
        w = list(near)
        w[rnd.randrange(len(w))] = f"new{i}"
        out.append(" ".join(w))
    return out + out[:20]


def classes(fps):
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("cap", [simhash.BUCKET_CAP, 2])
def test_simhash_classes(spark, cap, monkeypatch):
    monkeypatch.setattr(simhash.fingerprint_links, "__defaults__", (simhash.BITS, cap))
    texts = planted(1)
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    fps = [simhash.fingerprint(t or "") for t in texts]
    assert got == dict(enumerate(zip(fps, classes(fps), strict=True)))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    assert {r["node"]: r["root"] for r in simhash.components(links).collect()} == {i: 0 for i in range(1, 301)} | {1001: 1000}


def kept_words(texts, n=35):
    words = [(t or "").encode() for t in texts]
    words = [re.findall(rb"[^\x20\x09-\x0D]+", t) for t in words]
    count = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    for w in words:
        keep = [True] * len(w)
        for i in range(len(w) - n + 1):
            if count[tuple(w[i : i + n])] > 1:
                keep[i : i + n] = [False] * n
        kept = [x for x, k in zip(w, keep, strict=True) if k]
        yield len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def hot_everywhere(monkeypatch, on):
    """Takes every key that is in two contexts for a crowded one."""
    if on:
        monkeypatch.setattr(repeats.hot_keys, "__defaults__", (1, 2))


@pytest.mark.parametrize(("seed", "hot"), [(1, False), (2, False), (1, True)])
def test_cover_dedup(spark, seed, hot, monkeypatch):
    hot_everywhere(monkeypatch, hot)
    texts = planted(seed)
    got = {r[0]: tuple(r)[1:4] for r in cover_dedup.cut_words(frame(spark, texts)).collect()}
    assert got == dict(enumerate(kept_words(texts)))


def kept_bytes(texts, n=200):
    raws = [(t or "").encode() for t in texts]
    count = Counter(t[i : i + n] for t in raws for i in range(len(t) - n + 1))
    for t in raws:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        yield len(t), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(t, gone, strict=True) if not g)).hexdigest()


@pytest.mark.parametrize(("seed", "cap", "hot"), [(1, bwt_dedup.GROUP_CAP, False), (2, 3, False), (1, bwt_dedup.GROUP_CAP, True)])
def test_bwt_dedup(spark, seed, cap, hot, monkeypatch):
    hot_everywhere(monkeypatch, hot)
    monkeypatch.setattr(bwt_dedup.look_closer, "__defaults__", (cap,))
    texts = planted(seed)
    got = {r[0]: tuple(r)[1:5] for r in bwt_dedup.cut_bytes(frame(spark, texts)).collect()}
    assert got == dict(enumerate(kept_bytes(texts)))


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_finds(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_and_bootstrap(spark):
    rnd = random.Random(4)
    soup = ["a@b.co", "a.b@c.d_e@f.gh", "1.2.3.4.5", "999.1.1.1", "00255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+12", "@", "x@y", "+", "12345678901234567890123", "é😀", "...", "a" * 50, "-", "5105105105105100", "+49.30.1234567-"]
    texts = [None, "", *soup]
    texts += [rnd.choice(["", " ", ", "]).join(rnd.choice(soup) for _ in range(rnd.randrange(12))) for _ in range(150)]
    for i in range(12):  # a context that mostly holds known cards, and unknown ones in it
        texts.append(f"words before paid with 4111 1111 1111 1111 here {i}")
        texts.append(f"words before paid with 510510510510510{i % 2 * 0} here")
    texts.append("words before paid with 998877665544 here")
    texts.append("quite another thing 998877665511 here")
    got = {r["doc_id"]: r for r in pii.span_digests(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        base = base_finds(t)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(b[0] == k for b in base) for k in BASE]
        assert set(joined.split(",")) - {""} <= set(got[i]["spans"].split(","))


def test_pii_bootstrap_discovers_unseen_values(spark):
    cards = ["4111111111111111", "5105105105105100", "4012888888881881", "5555555555554444"]
    texts = [f"we were charged to {c} on monday" for c in cards] + ["we were charged to 998877665544 on monday", "the phone book lists 998877665511 and more", "we were charged nothing"]
    got = {r["doc_id"]: r for r in pii.span_digests(frame(spark, texts)).collect()}
    assert got[4]["spans"] == "card:19:31" and got[4]["n_card"] == 0
    assert got[5]["spans"] == "" and got[6]["spans"] == ""


def test_pii_contexts_between_slots_and_rounds(spark):
    """Words between slots count, contexts are whole words, and values of one round are support of the next."""
    cards = "4111111111111111 5105105105105100 4012888888881881 5555555555554444 6011111111111117 6011000990139424 3530111333300000 3566002020360505".split()
    far, new = "x" * 61, [f"99887766554{i}" for i in (4, 5, 6)]
    texts = [f"room 12 card {c} paid" for c in cards] + [f"{far}words used {c} then" for c in cards]
    cases = [(f"room 7 card {v} paid", 12) for v in new]
    cases += [(f"{far}words used 112233445566 then", 72), ("ywords used 665544332211 at last", 12)]
    # The first pattern makes three values known; another has these alone, and a new one.
    cases += [(f"refund for {v} soon", 11) for v in (*new, "123123123123")]
    got = {r["doc_id"]: r["spans"] for r in pii.span_digests(frame(spark, texts + [t for t, _ in cases])).collect()}
    assert [got[len(texts) + i] for i in range(len(cases))] == [f"card:{at}:{at + 12}" for _, at in cases]


def test_pii_planted_identifiers(spark):
    """Unseen identifiers in six contexts among other numbers: recall and precision of what the bootstrap adds."""
    rnd = random.Random(7)
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(3, 8)))

    def luhn(body):
        total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(body[::-1]))
        return body + str(-total % 10)

    seed = {"phone": lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", "card": lambda: luhn("4" + digits(14)), "email": lambda: f"{word()}{digits(1)}@{word()}.org"}
    unseen = {"phone": lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", "card": lambda: "9" + digits(11), "email": lambda: f"{word()}{digits(1)}@{word()}"}
    contexts = {"phone": ("call me at", "phone number is"), "card": ("charged to card", "account no."), "email": ("write to", "mail address")}
    texts, want = [], set()
    for i in range(900):
        kind = rnd.choice(sorted(contexts))
        lead, plain = rnd.choice(contexts[kind]), rnd.random() < 0.7
        text = " ".join(word() for _ in range(rnd.randrange(8))) + f" {lead} "
        value = (seed if plain else unseen)[kind]()
        if not plain:
            want.add((i, kind, len(text), len(text) + len(value)))
        text += value + " " + " ".join(word() for _ in range(rnd.randrange(8)))
        texts.append(text + (f" {word()} {digits(rnd.randrange(6, 14))} {word()}" if i % 2 else ""))
    got = set()
    for r in pii.span_digests(frame(spark, texts)).collect():
        base = {f"{k}:{s}:{e}" for k, s, e in base_finds(texts[r["doc_id"]])}
        got |= {(r["doc_id"], k, int(s), int(e)) for k, s, e in (x.split(":") for x in r["spans"].split(",") if x and x not in base)}
    assert len(want) > 200 and len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.97 * len(got)


def test_redaction(spark):
    texts = [None, "", "mail a@b.co or +1 (988) 555-2485.", "é a@b.co", "é a@b.co"]
    got = {r["doc_id"]: r["text"] for r in pii.redacted(frame(spark, texts)).collect()}
    assert got == {0: None, 1: "", 2: "mail [EMAIL] or [PHONE].", 3: "é [EMAIL]", 4: "é [EMAIL]"}


def test_audio_rows(spark):
    texts = [None, "", "a", "x" * 192, "é" * 500, "é" * 500]
    rows = {r["doc_id"]: r for r in audio.audio_digests(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        full = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(full[-16:]) and r["media_sha256"] == hashlib.sha256(audio.wav(full)).hexdigest() and r["media_bytes"] == len(full) + 44
    assert rows[4]["feature"] == rows[5]["feature"] and rows[0]["feature"] == rows[1]["feature"]


def test_pieces_checked_against_the_library(spark):
    texts = planted(3)
    df = frame(spark, texts)
    got = {r["doc_id"]: tuple(r)[1:] for r in piece_bpe.piece_digests(df, MODEL, verify=True).collect()}
    lib = piece_bpe.PieceCoder(MODEL).lib
    for i, t in enumerate(texts):
        ids = lib.encode(t or "")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[i] == (len(ids), digest(",".join(map(str, ids))), digest(lib.decode(ids)))
    full = piece_bpe.encode_pieces(df, MODEL).filter("doc_id = 5").first()
    assert full["ids"] == lib.encode(texts[5]) and full["decoded"] == texts[5]


def test_tokens_of_fields(spark):
    texts = [None, "", "one\n\ntwo lines", "x"]
    rows = tokens.section_tokens(frame(spark, texts), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, fields=("source", "text")).collect()
    encoding, _ = tokens.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for i, t in enumerate(texts):
        own = [r for r in rows if r["doc_id"] == i]
        assert sum(r["n_tokens"] for r in own) == len(encoding.encode_ordinary("s\n" + (t or "")))
        assert [r["n_chars"] for r in own if r["field"] == "text"] == [len(x) for x in (t or "").split("\n")]


def test_language_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op5_language(spark, sf).collect()}
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [i for i, r in got.items() if r["held_out"]]
    assert len(got) == len(lang) and held == [i for i in held if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i]["lang_pred"] == lang[i] for i in held) >= 0.95 * len(held)


def test_language_edges(spark):
    profiles = {"en": langid.top(*langid.grams("the cat and the dog"), 400)}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(frame(spark, [None, "", "12 ! ² ½ Ⅷ", "the"]), profiles).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0) and got[3][0] == "en" and 0 < got[3][1] <= 1
    assert {r["lang_pred"] for r in langid.predict(frame(spark, ["the"]), {}).collect()} == {"und"}


def test_language_by_plain_distance(spark):
    """The out-of-place distance by its definition; equal languages tie to the first name."""
    rnd = random.Random(6)
    learn = {name: " ".join("".join(rnd.choice(abc) for _ in range(rnd.randrange(1, 7))) for _ in range(300)) for name, abc in (("aa", "abcde"), ("bb", "cdefg"), ("cc", "éfgh"))}
    texts = [" ".join("".join(rnd.choice("abcdefghé") for _ in range(4)) for _ in range(rnd.randrange(1, 60))) for _ in range(60)] + ["c"] + ["ab cd"] * 3 + ["abc " * 60_000]

    def ranked(text, n):
        count = Counter(g for w in re.findall(r"[^\W\d_]+", text.lower()) for k in (1, 2, 3) for g in [f" {w} "[i : i + k] for i in range(len(w) + 3 - k)] if g.strip())
        return [g for g, _ in sorted(count.items(), key=lambda x: (-x[1], sum(ord(c) << 21 * (len(x[0]) - 1 - i) for i, c in enumerate(x[0]))))][:n]

    profiles = {name: langid.top(*langid.grams(t), 400) for name, t in learn.items()}
    profiles["ab"] = profiles["aa"]
    plain = {name: ranked(learn["aa" if name == "ab" else name], 400) for name in profiles}
    assert all(len(plain[k]) == len(profiles[k]) for k in plain)
    for r in langid.predict(frame(spark, texts), profiles).collect():
        own, best = ranked(texts[r["doc_id"]], langid.DOCUMENT), None
        for name in sorted(plain):
            worst, at = max(len(plain[name]), langid.DOCUMENT), {g: i for i, g in enumerate(plain[name])}
            far = sum(abs(at[g] - i) if g in at else worst for i, g in enumerate(own)) / worst
            if best is None or far < best[0]:
                best = (far, name)
        assert r["lang_pred"] == best[1] and abs(r["score"] - max(0, 1 - best[0] / len(own))) < 1e-9


def test_long_and_repeated_rows(spark):
    """Very long texts and rows alike in everything, for the operators that judge each row by itself."""
    rnd = random.Random(12)
    item = " ".join(f"b{rnd.randrange(999)}" for _ in range(30))
    long = " ".join(f"u{rnd.randrange(99)}" for _ in range(120_000)) + " " + item
    df = spark.createDataFrame([(1, long), (1, long), (2, "x\n\ny"), (2, "x\n\ny"), (None, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (7, item), (8, "u1")], "item_id long, text string")
    hits = sorted((r["doc_id"], r["item_id"], r["start_word"], r["edits"]) for r in decontaminate.contaminated(df, bench).collect())
    at = long.split().index("u1")
    assert hits == sorted([(1, 7, 120_000, 0)] * 4 + [(1, 8, at, 0)] * 2)
    assert sorted((r["doc_id"] or 0) for r in decontaminate.without_items(df, bench).collect()) == [0, 2, 2]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoding, _ = tokens.vocabulary(path, public_tokenizers.PATTERN)
    rows = tokens.section_tokens(df, path, public_tokenizers.PATTERN).collect()
    assert sum(r["n_tokens"] for r in rows if r["doc_id"] == 1) == 2 * len(encoding.encode_ordinary(long))
    assert sum(r["n_tokens"] for r in rows if r["doc_id"] == 2) == 2 * len(encoding.encode_ordinary("x\n\ny"))
    digests = audio.audio_digests(df).collect()
    assert len(digests) == 5 and len({r["feature"] for r in digests}) == 3
    assert langid.predict(df, {"en": langid.top(*langid.grams("u b"), 400)}).filter("lang_pred = 'en'").count() == 4
    page = "<article>" + "<p>Some text, and more of it, and on.</p>" * 20_000 + "</article>"
    pages = spark.createDataFrame([(1, "u", page)] * 2, "page_id long, url string, html string")
    assert [r["n_chars"] for r in html_text.page_texts(pages).collect()] == [20_000 * 35 - 1] * 2


def test_decontamination_rows(spark):
    rnd = random.Random(2)
    item = " ".join(f"b{rnd.randrange(999)}" for _ in range(20))
    off = item.split()
    off[3], off[12] = "zz", "yy"
    texts = [None, "", f"pre {item.upper()}, post", " ".join(["pre"] * 30 + off), "nothing at all " * 20, " ".join(item.split()[:12])]
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (None, "x y z a b c"), (10, "too short")], "item_id long, text string")
    want = {(2, 7, 0), (3, 7, 2)}
    for chars in (decontaminate.BLOCK_CHARS, 60):
        assert {(r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.contaminated(frame(spark, texts), bench, block_chars=chars).collect()} == want
    assert decontaminate.contaminated(frame(spark, texts), bench.limit(0)).count() == 0


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>Hello, world &amp; all of you.</p></article>"), (2, None, None), (3, "u", "")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert sorted(map(tuple, html_text.page_texts(pages).collect())) == [(1, "u", "Hello, world & all of you.", 26), (2, None, "", 0), (3, "u", "", 0)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    profiles = langid.learn(none)
    for df in (
        simhash.near_duplicates(none),
        cover_dedup.cut_words(none),
        bwt_dedup.cut_bytes(none),
        pii.span_digests(none),
        pii.redacted(none),
        audio.audio_digests(none),
        piece_bpe.piece_digests(none, MODEL),
        langid.predict(none, profiles),
        decontaminate.contaminated(none, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")),
        html_text.page_texts(spark.createDataFrame([], "page_id long, url string, html string")),
        tokens.section_tokens(none, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
        decontaminate.without_items(none, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")),
    ):
        assert df.count() == 0


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(None, text), (1, text), (1, text), (1, "other"), (2, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in cover_dedup.cut_words(df).collect()) == [(-1, 60), (1, 0), (1, 60), (1, 60), (2, 0)]
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in bwt_dedup.cut_bytes(df).collect()) == [(-1, len(text)), (1, 0), (1, len(text)), (1, len(text)), (2, 0)]
    near = simhash.near_duplicates(df).collect()
    assert len(near) == 5 and {r["component_id"] for r in near if r["doc_id"] is None} == {1}
    assert len(pii.span_digests(df).collect()) == 5


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = corpus_pipeline.language(spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() == sum(any(c.isalpha() for c in r["text"] or "") for r in rows.values())
    once = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, sf).collect()}
    clean = corpus_pipeline.benchmark_passages(spark, docs, sf)
    items = [decontaminate.plain(r["text"]).decode().split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    holds = {i for i, r in rows.items() if any(f" {' '.join(x)} " in f" {decontaminate.plain(r['text']).decode()} " for x in items)}
    left = {r["doc_id"] for r in clean.collect()}
    assert holds and not holds & left and len(rows) - len(left) <= len(holds) + 3
    masked = {r["doc_id"]: r for r in corpus_pipeline.personal_data(spark, docs, sf).collect()}
    for i, r in rows.items():
        t, at, out = r["text"] or "", 0, ""
        for k, s, e in sorted(base_finds(t), key=lambda x: x[1]):
            if s >= at:
                out, at = out + t[at:s] + f"[{k.upper()}]", e
            at = max(at, e)
        assert masked[i]["text"] == out + t[at:] and masked[i]["n_chars"] == len(masked[i]["text"])
    result = corpus_pipeline.run(spark, sf)
    assert result.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r["doc_id"] for r in result.collect()} <= once - holds
