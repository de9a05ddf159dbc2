"""Cases of the page extractor, decontamination, languages and identifiers that went wrong before."""

import random
import time

import numpy as np
import pytest

from factloom.llm import decontaminate, html_text, langid, pii
from factloom.llm.hashing import word_hashes

LONG = "This paragraph belongs to the article, it has commas, and it is long enough to count as text of its own."


@pytest.mark.parametrize("attributes", ['data-hidden="false"', 'title="a hidden gem"', 'data-src="/x?class=comments"', 'data-id="sidebar"', "title='class=menu'", 'alt="hidden" class="lead"', "data-role=navigation", 'class="lead" class="comments"'])
def test_attribute_values_are_no_names(attributes):
    page = f"<html><body><article><p>{LONG}</p><p {attributes}>Kept words, of this paragraph.</p><p>{LONG}</p></article></body></html>"
    assert html_text.main_text(page) == f"{LONG} Kept words, of this paragraph. {LONG}"


@pytest.mark.parametrize("attributes", ["hidden", 'hidden=""', 'class="comments"', "id=sidebar", "role='navigation'", 'aria-hidden="true"', 'style="color: red; display: none"', 'title="x"hidden'])
def test_named_attributes_take_out(attributes):
    page = f"<html><body><article><p>{LONG}</p><div {attributes}>Gone.</div><p>{LONG}</p></article></body></html>"
    assert html_text.main_text(page) == f"{LONG} {LONG}"


@pytest.mark.parametrize("page", ["<b><div>" + "<span>" * 20_000 + "</b>" * 20_000, "<blockquote>" * 20_000, "<ul>" + "<li>a" * 20_000, "<p><i>" * 20_000 + "</p>" * 20_000, "<select>" + "<option>" * 20_000 + "</select>x"])
def test_pages_of_stray_tags_are_linear(page):
    began = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - began < 2


def reference_tree(tags):
    """Nesting by searching the whole stack for every tag."""
    stack, out = ["html"], []
    for closing, name in tags:
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i] == name:
                    del stack[i:]
                    break
                if name not in html_text.BLOCKS and stack[i] in html_text.BARRIERS:
                    break
            continue
        closes = html_text.IMPLIED.get(name, frozenset()) | ({"p"} if name in html_text.ENDS_P else frozenset())
        for i in range(len(stack) - 1, 0, -1):
            if stack[i] in closes:
                del stack[i:]
                break
            if stack[i] in html_text.BARRIERS:
                break
        out.append("/".join([*stack, name]))
        stack.append(name)
    return out


def test_parsed_nesting_against_a_full_search():
    rnd = random.Random(3)
    names = ["p", "b", "div", "ul", "li", "table", "tr", "td", "span", "article", "dl", "dd", "h2"]
    for _ in range(500):
        tags = [(rnd.random() < 0.4, rnd.choice(names)) for _ in range(rnd.randrange(40))]
        root = html_text.parse("".join(f"<{'/' if c else ''}{n}>" for c, n in tags))
        got, todo = [], [(c, "html") for c in reversed(root.children)]
        while todo:
            node, path = todo.pop()
            if isinstance(node, html_text.Node):
                got.append(f"{path}/{node.name}")
                todo += [(c, got[-1]) for c in reversed(node.children)]
        assert got == reference_tree(tags)


def held(items, text, share=decontaminate.SHARE):
    tables = decontaminate.tables(list(enumerate(items)), share)
    raw = decontaminate.plain(text).split()
    words = word_hashes(np.frombuffer(b" ".join([*raw, b""]), np.uint8))[1]
    return {int(t.ids[hit[0]]) for t in tables for hit in t.matches(words, raw)}


def test_a_repeated_run_of_an_item_is_passed_over_fast():
    item = " ".join(f"w{i}" for i in range(600))
    began = time.perf_counter()
    assert held([item], "w10 w11 w12 w13 " * 10_000) == set()
    assert time.perf_counter() - began < 2


def test_windows_keep_every_edited_item():
    rnd = random.Random(8)
    for size in (2, 5, 15, 40, 90, 200):
        item = [f"i{rnd.randrange(50)}" for _ in range(size)]
        limit = int(size * decontaminate.SHARE + 1e-9)
        table = decontaminate.tables([(0, " ".join(item))], decontaminate.SHARE)[0]
        for _ in range(30):
            words = list(item)
            for _ in range(limit):
                at = rnd.randrange(len(words))
                rnd.choice((lambda: words.__setitem__(at, "new"), lambda: words.pop(at) if len(words) > 1 else None, lambda: words.insert(at, "more")))()
            around = [[f"a{rnd.randrange(900)}" for _ in range(300)] for _ in range(2)]
            text = " ".join([*around[0], *words, *around[1]])
            full = word_hashes(np.frombuffer(f"{text} ".encode(), np.uint8))[1]
            starts, sizes = table.windows(full)
            # Some window of the item's size whose words are within the limit is there: the one that begins with the passage, or near it.
            assert any(abs(int(s) - 300) <= limit and n == size for s, n in zip(starts, sizes, strict=True)) or size + limit < 3


def test_long_texts_are_cut_between_words(monkeypatch):
    rnd = random.Random(5)
    text = "".join(rnd.choice("abcé ,.7\n") for _ in range(3000)) + "x" * 200 + " end"
    whole = langid.grams(text)
    for piece in (1, 7, 64, 1000):
        monkeypatch.setattr(langid, "PIECE", piece)
        assert all((a == b).all() for a, b in zip(langid.grams(text), whole, strict=True))
        assert len(langid.grams("")[0]) == 0


@pytest.mark.parametrize("blank", [" ", "    ", "\t \n"])
def test_identifiers_after_any_white_space(spark, blank):
    rnd = random.Random(6)
    texts = [f"noise words then{blank}call{blank}line{blank}+1 202 555 {1000 + i} today" for i in range(20)]
    unseen = [f"other words and{blank}call{blank}line{blank}55{i} 77{rnd.randrange(1000, 9999)} now" for i in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts + unseen)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.span_digests(docs).select("doc_id", "spans").collect()}
    assert all(got[i] for i in range(25))
