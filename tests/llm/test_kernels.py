"""Helpers without Spark: codes, coders, transforms, filters, trees."""

import random
import re
from itertools import combinations

import numpy as np
import pyarrow.parquet as pq
import pytest

from factloom.llm import audio, bwt_dedup, decontaminate, html_text, langid, piece_bpe, repeats, simhash, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def texts():
    return [t or "" for t in pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()]


def test_golay_words_within_two_bits_share_an_index():
    rng = np.random.default_rng(0)
    w = rng.integers(0, 1 << 23, 400).astype(np.uint32)
    own = simhash.codeword_indices(w)
    for bits in [(), *combinations(range(23), 1), *combinations(range(23), 2)]:
        flip = np.uint32(sum(1 << b for b in bits))
        other = simhash.codeword_indices(w ^ flip)
        assert (own[:, :, None] == other[:, None, :]).any((1, 2)).all()


def test_fingerprints_within_two_bits_share_a_key():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 1 << 63, 3000).astype(np.int64)
    flip = (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)) | (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64))
    a, b = simhash.golay_keys(fp), simhash.golay_keys((fp.view(np.uint64) ^ flip).view(np.int64))
    assert (a[:, :, None] == b[:, None, :]).any((1, 2)).all()


def test_fingerprint_by_definition():
    import xxhash

    for text in ["", "One", "two Words", "a b\tC d", "x " * 70_000, "É À b c d"]:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_pieces_equal_the_library():
    c = piece_bpe.PieceCoder(public_tokenizers.path("piece_bpe_32k.model"))
    odd = ["", " ", "  a", "a  ", "\n", "▁x", "a▁b", "<s>", "</s> x", "<unk>", "\x00a", "日本語 テスト 😀 x", "\t\ta", "<0x41>", "é" * 5, "ﬁ ½", "A" * 300, "   x   y", "ab" * 5000]
    c.check(odd + texts())


def test_words_worked_together_equal_one_agenda_and_the_library(monkeypatch):
    rnd, c = random.Random(3), piece_bpe.PieceCoder(public_tokenizers.path("piece_bpe_32k.model"))
    monkeypatch.setattr(piece_bpe, "KEEP_WORDS", 700)
    mixed = ["".join(rnd.choice("abcdeth in  ,.\n\t▁éñ漢😀\x00g01") for _ in range(rnd.randrange(120))) for _ in range(1500)]
    for at in range(0, len(mixed), 100):
        some = mixed[at : at + 100]
        assert c.ids_texts(some) == [",".join(map(str, c.lib.encode(t))) for t in some]
        for w in {w for t in some for w in c.words(t) if len(w) < piece_bpe.SHORT}:
            symbols = c.merge(piece_bpe.SPACE + w.replace(" ", piece_bpe.SPACE))
            assert dict(c.merge_many([w]))[w] == ",".join(str(c.ids[s]) if s in c.ids else c.bytes_ids(s) for s in symbols)
    assert c.older and c.ids_texts([]) == [] and c.ids_texts(["", " "])[0] == ""


def test_tokens_of_sections_add_up_and_follow_the_rule():
    encoding, lengths = tokens.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for text in [*texts()[:40], "", "\n\n\n", "a\n\n  b é😀\n", "日本語\n日本"]:
        starts, ends = tokens.token_spans(text, encoding, lengths)
        of_byte = [i for i, c in enumerate(text) for _ in c.encode()]
        at, spans = 0, []
        for i in encoding.encode_ordinary(text):  # brute force over bytes
            spans.append((of_byte[at], of_byte[at + int(lengths[i]) - 1] + 1))
            at += int(lengths[i])
        assert list(zip(starts.tolist(), ends.tolist())) == spans
        lines = text.split("\n")
        sections = np.cumsum([0] + [len(x) + 1 for x in lines[:-1]])
        counts = tokens.attribute(starts, ends, sections)
        assert counts.sum() == len(starts)
        expected = np.zeros(len(sections), int)
        for s, e in zip(starts.tolist(), ends.tolist()):
            share = [sum(sections[k] <= x < (sections[k + 1] if k + 1 < len(sections) else 1 << 60) for x in range(s, e)) for k in range(len(sections))]
            expected[share.index(max(share))] += 1
        assert counts.tolist() == expected.tolist()


def test_wav_round_trip_and_features_repeat():
    for n in (192, 384, 19_200):
        raw = bytes(random.Random(n).randrange(256) for _ in range(n))
        rate, back = audio.read_wav(audio.wav(raw))
        assert (rate, back) == (audio.SOURCE_RATE, raw)
        a, b = audio.features(raw), audio.features(bytes(raw))
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_resampling_is_the_polyphase_sum():
    x = np.random.default_rng(0).standard_normal(60).astype(np.float32)
    branches, taps = audio.polyphase(), audio.TAPS
    y = audio.resample(x)
    assert len(y) == 40
    for k in range(40):
        at, b = k * audio.DOWN // audio.UP, branches[k * audio.DOWN % audio.UP]
        assert abs(y[k] - sum(b[t] * x[at - t] for t in range(taps) if 0 <= at - t < 60)) < 1e-4


def test_hysteresis_spans():
    e = np.array([0, 0, 5, 1, 1, -9, 1, 1, 9, 0.5, 0.5], float)
    e -= e.mean()
    brute, on, spans = [], False, []
    for i, v in enumerate(e):
        on = True if v >= 1 else False if v < -1 else on
        brute.append(on)
    edges = np.flatnonzero(np.diff([0, *map(int, brute), 0]))
    assert audio.active_spans(e).tolist() == edges.reshape(-1, 2).tolist()


def test_tensor_stream_has_fixed_shape_and_times():
    import pyarrow as pa

    mel = np.random.default_rng(0).standard_normal((70, audio.MELS)).astype(np.float32)
    t = pa.ipc.open_stream(audio.tensor_stream(mel, np.array([[3, 40]]))).read_all()
    assert t.schema.field("logmel").type == audio.TENSOR and t.num_rows == 3
    back = np.concatenate([c.to_numpy_ndarray() for c in t["logmel"].chunks]).reshape(-1, audio.MELS)
    assert (back[:70] == mel).all()
    assert t["start_s"].to_pylist() == [0, 32 * 128 / 8000, 64 * 128 / 8000] and t["active"].to_pylist() == [29 / 32, 8 / 32, 0]


def test_collection_bwt_by_sorting():
    rnd = random.Random(5)
    strings = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(1, 30))) for _ in range(40)]
    bwt, lcp = bwt_dedup.collection_bwt(strings)
    rows = sorted((s[i:], k, i) for k, s in enumerate(strings) for i in range(len(s)))

    def common(x, y):
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        return n

    m = len(strings)
    assert lcp[m:].tolist() == [0, *(common(a[0], b[0]) for a, b in zip(rows, rows[1:]))]
    assert bwt[m:].tolist() == [strings[k][i - 1] + 1 if i else 0 for _, k, i in rows]


def test_merged_spans():
    s, e = repeats.merged(np.array([5, 1, 3, 9]), np.array([6, 3, 5, 12]))
    assert list(zip(s.tolist(), e.tolist())) == [(1, 6), (9, 12)]


def edited_words(rnd, words, n, kinds="sid"):
    words = list(words)
    for _ in range(n):
        kind, p = rnd.choice(kinds), rnd.randrange(len(words))
        if kind == "s":
            words[p] = b"z%d" % rnd.getrandbits(60)
        elif kind == "i":
            words.insert(p, b"z%d" % rnd.getrandbits(60))
        elif len(words) > 1:
            del words[p]
    return words


def held(table, words):
    return {m[0] for m in table.matches(decontaminate.word_hashes(np.frombuffer(b" ".join(words), np.uint8))[1], words)}


def test_decontamination_recall_against_brute_force():
    rows = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
    (table,) = decontaminate.tables([(r["item_id"], r["text"]) for r in rows])
    rnd, total, found = random.Random(3), 0, 0
    for case in range(150):
        k = rnd.randrange(len(table.ids))
        n, limit = int(table.sizes[k]), int(table.limits[k])
        pad = [[b"z%d" % rnd.getrandbits(60) for _ in range(40)] for _ in range(2)]
        words = [*pad[0], *edited_words(rnd, table.raw[k], rnd.randrange(limit + 1)), *pad[1]]
        doc = decontaminate.word_hashes(np.frombuffer(b" ".join(words), np.uint8))[1]
        view = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(doc, n))
        edits = decontaminate.edit_distances(view, np.repeat(table.words[k : k + 1, :n], len(view), 0), np.array([limit]))
        if edits.min() <= limit:
            total += 1
            found += k in held(table, words)
    assert total > 80 and found >= 0.97 * total
    assert not any(held(table, [b"z%d" % rnd.getrandbits(60) for _ in range(200)]) for _ in range(5))


@pytest.mark.parametrize(("size", "kinds"), [(300, "s"), (300, "sid"), (600, "s")])
def test_decontamination_of_long_items(size, kinds):
    rnd, found, total = random.Random(size), 0, 0
    item = [b"w%d" % rnd.randrange(5000) for _ in range(size)]
    (table,) = decontaminate.tables([(1, b" ".join(item).decode())])
    for _ in range(8):
        words = edited_words(rnd, item, size // 10 if "i" in kinds else size // 5, kinds)
        total += 1
        found += held(table, [b"a"] * 30 + words + [b"b"] * 30) == {0}
    assert found >= total - 1


def test_decontamination_of_short_items_and_document_ends():
    tables = decontaminate.tables([(1, "Two words"), (2, "one"), (3, " ".join(f"w{i}" for i in range(40)))])
    (table,) = tables
    assert held(table, b"here are two words".split()) == {0} and held(table, b"two other words".split()) == set()
    assert held(table, [b"one"]) == {1}
    assert held(table, [b"w%d" % i for i in range(40) if i != 7]) == {2}  # one word fewer than the item, and nothing around it


def test_edit_distance_band():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i, *[0] * len(b)], row
            for j, y in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        return row[-1]

    rnd = random.Random(1)
    for _ in range(100):
        n = rnd.randrange(1, 12)
        a, b = [rnd.randrange(3) for _ in range(n)], [rnd.randrange(3) for _ in range(n)]
        limit = rnd.randrange(n + 1)
        got = int(decontaminate.edit_distances(np.array([a], np.uint64), np.array([b], np.uint64), np.array([limit]))[0])
        true = plain(a, b)
        assert got == true if true <= limit else got > limit


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header class="site-header"><h1>Site</h1></header><nav><ul><li><a href="/">Home, of, many, commas</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, and more, to track, you, always, and everywhere, forever.</p></div>
<div id="content"><article><h1>Head &amp; tail</h1><p>First  <b>bold</b>text,\n with commas, and   length enough to count.<p>Second paragraph, unclosed &lt;tag&gt; &#233;, long enough.
<aside>aside text, with, commas, many</aside><form><p>Mail, us, now</p><input></form><ul><li>item one<li>item two</ul></article>
<section class="comments"><p>A reader, wrote, this, and that, and that, and more of that too.</p></section></div>
<div class="sidebar"><p>Related, links, here, and, there</p></div><footer>Foot</footer></body></html>"""


def test_main_text_of_a_page():
    assert html_text.main_text(PAGE) == "Head & tail First boldtext, with commas, and length enough to count. Second paragraph, unclosed <tag> é, long enough. item one item two"


def test_main_text_without_article_and_odd_pages():
    page = "<body><div class=menu><a href=x>A, b, c, d, e, f, g, h, i, j, k</a></div><div><p>" + "Long, plain text. " * 20 + "</p><p>Short end.</p></div><div><p>" + "More, of the text. " * 20 + "</p></div></body>"
    got = html_text.main_text(page)
    assert got.startswith("Long, plain") and "Short end." in got and got.endswith("More, of the text.") and "A, b" not in got
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<html></html>") == ""
    assert html_text.main_text("just text") == "just text"
    assert html_text.main_text("<div>" * 5000 + "deep text" + "</div>" * 5000) == "deep text"
    assert html_text.main_text("<p>a<") == "a<"


def test_grams_and_ranks():
    codes, n = langid.grams("Ab, ab! 12")
    assert dict(zip(codes.tolist(), n.tolist()))[ord("a") << 21 | ord("b")] == 2
    assert len(langid.grams("123 !? ")[0]) == 0
    assert len(langid.top(codes, n, 3)) == 3


def test_numerals_are_no_letters():
    assert all(not len(langid.grams(t)[0]) for t in ("²", "½ ³", "Ⅷ", "٣", "_", "৪ 12"))
    assert len(langid.grams("a² é")[0]) and len(langid.grams("日本")[0])


def test_article_parts_with_suspicious_names_stay():
    long = "Plain text of the article, long enough, with commas. " * 3
    page = f'<body><div class="side">away, away, away, and away again</div><article><div class="entry-header"><h1>Headline</h1></div><p>{long}</p><section id="related-work"><p>{long}</p></section><div class="side"><p>{long}</p></div><div class="comments"><p>A reader, wrote, this, and more</p></div><div class="related-posts">more, to, read</div></article></body>'
    got = html_text.main_text(page)
    assert got == " ".join(["Headline", long.strip(), long.strip(), long.strip()])


def test_deep_pages_are_quick():
    import time

    began = time.perf_counter()
    for name in ("blockquote", "li", "td", "b", "div"):
        page = "".join(f"<{name}>a, b " for _ in range(20_000))
        assert html_text.main_text(f"<p>x{page}").count("a, b") == 20_000
        html_text.main_text(page + "</i></p></zz>" * 20_000)
    assert time.perf_counter() - began < 10


def test_scores_of_random_trees():
    """Points by their definition, recursively, against the counts on the way up."""
    rnd = random.Random(8)

    def build(parent, depth):
        for _ in range(rnd.randrange(4)):
            if rnd.random() < 0.5:
                parent.children.append(rnd.choice(["a, b, c", " ", "some words that are longer, than a few", "x" * rnd.randrange(300)]))
            elif depth:
                node = html_text.Node(rnd.choice("p div td li a b section h2 span article".split()), parent, float(rnd.randrange(3)), rnd.random() < 0.1)
                parent.children.append(node)
                build(node, depth - 1)

    def nodes(node):
        yield node
        for c in node.children:
            if isinstance(c, html_text.Node) and not c.dropped:
                yield from nodes(c)

    def strings(node, linked=False):
        for c in node.children:
            if isinstance(c, str):
                yield c, linked or node.name == "a"
            elif not c.dropped:
                yield from strings(c, linked or node.name == "a")

    for _ in range(150):
        root = html_text.Node("body", html_text.Node("html", None))
        build(root, 6)
        want = {id(n): n.points for n in nodes(root)}
        for n in nodes(root):
            if n.name not in html_text.PARAGRAPHS:
                continue
            mixed = n.name in ("div", "section", "article", "main", "body")
            parts = [c for c in n.children if isinstance(c, str)] if mixed else [s for s, _ in strings(n)]
            size = len(" ".join(parts).strip()) if mixed else sum(len(s.strip()) for s in parts)
            if size >= 25 or (size and not mixed):
                points, up = 1 + "".join(parts).count(",") + min(size / 100, 3), n if mixed else n.parent
                for level, share in ((up, 1), (up.parent, 0.5)):
                    if level is not None and id(level) in want:
                        want[id(level)] += points * share
        html_text.score(root)
        for n in nodes(root):
            assert abs(n.points - want[id(n)]) < 1e-9
            assert n.chars == sum(len(s.strip()) for s, _ in strings(n))
        assert root.linked == sum(len(s.strip()) for s, linked in strings(root) if linked)


def test_log_mel_by_definition():
    """Frames, window, transform and triangles of a short clip, term by term."""
    samples = bytes(random.Random(3).randrange(256) for _ in range(1152))
    mel, energy = audio.features(samples)
    y = audio.resample((np.array(list(samples), np.float32) - 128) / 128).astype(float)
    size, hop = audio.WINDOW, audio.HOP
    y = np.append(y, np.zeros(size))
    to_mel, to_hz = lambda f: 2595 * np.log10(1 + f / 700), lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = [to_hz(to_mel(audio.RATE / 2) * k / (audio.MELS + 1)) for k in range(audio.MELS + 2)]
    for f in range(len(mel)):
        frame = [y[f * hop + t] * (0.5 - 0.5 * np.cos(2 * np.pi * t / (size - 1))) for t in range(size)]
        power = [abs(sum(v * np.exp(-2j * np.pi * k * t / size) for t, v in enumerate(frame))) ** 2 for k in range(size // 2 + 1)]
        for m in range(audio.MELS):
            lo, mid, hi = edges[m : m + 3]
            total = sum(p * max(0.0, min((hz - lo) / (mid - lo), (hi - hz) / (hi - mid))) for k, p in enumerate(power) for hz in [k * audio.RATE / size])
            assert abs(mel[f, m] - np.log(total + 1e-6)) < 1e-2
        assert abs(energy[f] - 10 * np.log10(np.mean(np.square(frame)) + 1e-9)) < 1e-2
    assert len(mel) == -(-(len(samples) * 2 // 3 - size) // hop) + 1
