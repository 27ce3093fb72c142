"""Page text, token output, substring dedup, toxicity, BPE and secrets: round trips and brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from reelquery.llm import bpe_stream, html_text, secret_scan, substring_dedup, token_output, toxicity
from reelquery.llm.queries import BYTE_VOCABULARY, WORD_VOCABULARY, op6_substring_dedup, op7_toxicity, vocabulary

from .test_stages import ODD, frame

BYTES, WORDS = vocabulary(BYTE_VOCABULARY), vocabulary(WORD_VOCABULARY)
LETTERS = "ab  \n\t\x1c\x85\xa0 'streÉé日😀0¼.,_-İΣς́|<>"
odd_text = st.text(st.sampled_from(LETTERS), max_size=40) | st.lists(
    st.sampled_from(["<|endoftext|>", "a", " ", "<|", "'s", "don't", "\n\n", "The,", "X."])
).map("".join)


@settings(max_examples=300, deadline=None)
@given(odd_text)
def test_bpe_equals_the_library(text):
    coder, library = bpe_stream.transducer(BYTES), Tokenizer.from_file(BYTES)
    ids = [i for run in coder.encoded(text) for raw, _, _ in run for i in np.frombuffer(raw, "<u4").tolist()]
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert "".join(coder.decode(ids)) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 700, "ha" * 400, "=-" * 500, " " * 600, "abcdefghij" * 70, "é日" * 200])
def test_bpe_stream_needs_no_end_in_sight(text):
    coder = bpe_stream.transducer(BYTES)
    want = Tokenizer.from_file(BYTES).encode(text, add_special_tokens=False).ids
    assert [i for p in bpe_stream.PIECES.findall(text) for i in coder.stream(p.encode())] == want


def test_bpe_decodes_broken_bytes_like_the_library():
    coder, rnd = bpe_stream.transducer(BYTES), random.Random(4)
    ids = [coder.ids[bytes([rnd.randrange(256)])] for _ in range(500)]
    assert "".join(coder.decode(ids)) == Tokenizer.from_file(BYTES).decode(ids, skip_special_tokens=False)


def test_bpe_rows(spark):
    rows = bpe_stream.encode_decode(frame(spark, ODD), BYTES).collect()
    assert len(rows) == len(ODD) and all(r["lossless"] for r in rows)
    empty = next(r for r in rows if r["doc_id"] == 1)
    assert (empty["n_tokens"], empty["ids_sha256"]) == (0, hashlib.sha256(b"").hexdigest())
    assert bpe_stream.encode_decode(frame(spark, []), BYTES).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 70_000) | st.integers(0, 1), max_size=300))
def test_simple8b_round_trip(ids):
    packed = token_output.pack(np.array(ids, np.uint64))
    assert len(packed) % 8 == 0
    assert token_output.unpack(packed).tolist() == ids


def test_simple8b_takes_the_fullest_word():
    assert len(token_output.pack(np.zeros(120, np.uint64))) == 16
    assert len(token_output.pack(np.full(8, 30_000, np.uint64))) == 16


@settings(max_examples=200, deadline=None)
@given(odd_text)
def test_word_ids_equal_the_library(text):
    want = Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(token_output.encode_batch(WORDS, [text])[0], "<u4").tolist() == want


def test_words_of_a_line_end_where_the_library_ends_them():
    """New words are encoded many to a line; marks that reorder or vanish must not move a cut."""
    from tokenizers import Tokenizer

    rnd = random.Random(12)
    library = Tokenizer.from_file(WORDS)
    library.no_truncation()
    library.no_padding()
    parts = ["a", "Be", "ing", "7", "'s", "'", ".", ",", "\u0301", "e\u0323\u0302", "e\u0302\u0323", "\u1100\u1161", "\u212b", "\u0130", "\u03a3",
             "\u00a0", "\u2028", "\x85", "\x00", "\ufeff", "\u200b", "\U0001f600", "\ufb01", "<|", "<|endoftext|>", "|>", "\u4f60"]
    texts = [" ".join("".join(rnd.choices(parts, k=rnd.randint(1, 6))) for _ in range(rnd.randint(0, 300))) for _ in range(60)]
    coded = token_output.encode_batch(WORDS, texts)
    for text, ids in zip(texts, coded, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_table(spark, monkeypatch):
    monkeypatch.setattr(token_output, "BLOCK_IDS", 50)
    rows = [(i, t) for i, t in ODD if i != 4] + [(i, f"some words, number {i} here") for i in range(10, 60)]
    got = {r["doc_id"]: tuple(r)[1:] for r in token_output.token_output(frame(spark, rows), WORDS).collect()}
    library, at = Tokenizer.from_file(WORDS), 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_output.token_output(frame(spark, []), WORDS).count() == 0
    assert token_output.token_output(frame(spark, [(1, "a"), (1, "a")]), WORDS).count() == 2


def brute_repeats(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        words = (text or "").encode().split()
        covered = [False] * len(words)
        for at in range(len(words) - 19):
            window = tuple(words[at : at + 20])
            if window in seen:
                covered[at : at + 20] = [True] * 20
            seen.add(window)
        kept = b" ".join(w for w, c in zip(words, covered, strict=True) if not c)
        out[i] = (len(words), sum(covered), hashlib.sha256(kept).hexdigest())
    return out


def test_substring_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SEGMENT", 37)
    rnd = random.Random(6)
    passage = [f"p{i}" for i in range(200)]
    rows = []
    for i in range(60):
        words = [rnd.choice("abc") for _ in range(rnd.choice([0, 10, 19, 20, 60]))]
        for _ in range(rnd.randrange(4)):
            a = rnd.randrange(170)
            words += passage[a : a + rnd.randrange(5, 60)] + [f"u{rnd.randrange(10**6)}"] * rnd.randrange(30)
        rows.append((i, " ".join(words)))
    rows += [(100, "z " * 90), (101, rows[5][1]), (102, None), (103, "")]
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == brute_repeats(rows)


def test_substring_query_and_odd_rows(spark, folder):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = {r["doc_id"]: tuple(r)[1:] for r in op6_substring_dedup(spark, folder).collect()}
    assert got == brute_repeats(rows)
    assert len(substring_dedup.remove_repeats(frame(spark, ODD)).collect()) == len(ODD)
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0
    long = " ".join(map(str, range(40)))
    twice = substring_dedup.remove_repeats(frame(spark, [(1, long), (1, long), (1, long + " x"), (2, long)])).collect()
    assert sorted(r["n_removed"] for r in twice if r["n_words"] == 40 and r["doc_id"] == 2) == [40]
    assert sum(r["n_removed"] for r in twice) in (80, 120)


def test_page_text(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a>Menu</a></ul></nav>"
        "<div class='ad'>Buy</div><article><header><h1>Head &amp;\n line</h1></header><p>One<br>two &lt; three"
        "<p>Last<form>f</form><section class='comments'><p>reader</p></section></article>"
        "<footer>&copy; x</footer><script>if (a<b) {}</script></body>"
    )
    plain = "<p>Template</p><p>Own text {}</p><p>End line</p>"
    rows = [
        (1, "http://a.org/x", page), (2, "http://b.org/1", plain.format("one")), (3, "http://b.org/2", plain.format("two")),
        (4, None, None), (5, "", ""), (6, "http://c.org/", "no markup < at all"), (7, "http://b.org/1?q", None),
    ]
    pages = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, lines string, n_chars long")
    got = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    assert {i: r["text"] for i, r in got.items()} == {
        1: "Head & line\nOne two < three\nLast", 2: got[2]["text"], 3: "Own text two", 4: "", 5: "", 6: "no markup < at all", 7: "",
    }
    assert "Own text one" in got[2]["text"] and got[1]["n_chars"] == len(got[1]["text"])
    assert html_text.extract(pages.limit(0)).count() == 0
    assert html_text.extract(pages.union(pages)).count() == 2 * len(rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_shared_lines_are_a_longest_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    places = sorted(html_text.shared(a, b))
    rest = iter(b)
    assert len(places) == table[-1][-1] and all(a[i] in rest for i in places)


@pytest.mark.parametrize("markup, want", [
    ('<div class="main-content has-sidebar"><p>Text one</p><p>Two</p></div>', "Text one\nTwo"),
    ('<div class="content no-sidebar"><article><p>Inside</p></article></div>', "Inside"),
    ('<article><div class="entry-header"><h1>Title</h1></div><p>Body</p></article>', "Title\nBody"),
    ('<article><header><h1>Title</h1></header><p class="notice">Mind this</p><p class="side-by-side">Both</p></article>', "Title\nMind this\nBoth"),
    ('<div class="sidebar"><p>Menu</p><main><p>Main</p></main></div><div class="comments"><article>Reader</article></div>', "Main"),
    ('<article><p>Text</p><div class="ad">Buy</div><div class="x comments">Says</div><span class="ad">now</span></article>', "Text"),
    ('<div class="header">Top</div><p>Only text</p><aside><article>Teaser</article></aside><p hidden>No</p>', "Only text"),
    ('<div data-hidden-count="3" title="hidden"><p>Seen</p></div>', "Seen"),
])
def test_furniture_is_told_by_whole_names(markup, want):
    page = html_text.Page(1, "u", "h", *html_text.page_lines(markup))
    assert html_text.main_text(page, None) == want


def test_copies_without_an_article_stay_whole_and_long_pages_end():
    lines = [f"line {i}" for i in range(10)]
    page = html_text.Page(1, "u", "h", lines, [html_text.BODY] * 10)
    assert html_text.main_text(page, html_text.Page(2, "v", "h", lines, [html_text.BODY] * 10)) == "\n".join(lines)
    rnd = random.Random(3)
    a, b = ([f"x{rnd.randrange(5000)}" for _ in range(12_000)] for _ in range(2))
    assert len(html_text.shared(a, b)) > 100


def test_differencing_tells_the_own_article_of_a_page():
    """A teaser that the neighbour has too goes; a quotation in an own article and copies of articles stay."""
    def page(key, *articles, inside="main"):
        parts = "".join(f"<article>{''.join(f'<p>{line}</p>' for line in a)}</article>" for a in articles)
        return html_text.Page(key, "u", "h", *html_text.page_lines(f"<{inside}>{parts}</{inside}><p>Foot {key}</p>"))

    for inside in ("main", "div"):
        one, two = (page(k, ["Read this", "too"], [f"Text {k}", "Quoted"], inside=inside) for k in (1, 2))
        assert html_text.main_text(one, two) == "Text 1\nQuoted" and html_text.main_text(two, one) == "Text 2\nQuoted"
        assert html_text.main_text(one, None) == "Read this\ntoo\nText 1\nQuoted"
        copies = [page(k, ["Same", "text"], ["Again"], inside=inside) for k in (1, 2)]
        assert html_text.main_text(*copies) == "Same\ntext\nAgain"
    nested = html_text.Page(1, "u", "h", *html_text.page_lines("<article><p>A</p><article><p>B</p></article><p>C</p></article>"))
    assert nested.kinds == [html_text.ARTICLE] * 3


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200))
def test_any_markup_is_read(text):
    lines, kinds = html_text.page_lines(f"<p>{text}</div><table>")
    assert len(lines) == len(kinds) and all(line == " ".join(line.split()) or line for line in lines)


def test_grammar_readings():
    grammar = toxicity.Grammar({"grobia": 1.0})
    read = lambda text: dict(zip(toxicity.READINGS, grammar.features(text), strict=True))
    assert read("You are an idiot.")["targeted"] == 1
    assert read("What an idiot move by that guy there")["plain"] == 1
    assert read("You are not an idiot.")["negated"] == 1
    assert read("Someone said: that idiot")["reported"] == 1
    assert read("I will kill you")["threat"] == 1
    assert read("Ein grobian!")["plain"] == 1
    assert not grammar.features("idiotproof? skill, not kills. You said never.").any()
    scores = [grammar.score(t) for t in ("You are an idiot", "an idiot", "he said an idiot", "a nice day", "")]
    assert scores[0] > scores[1] > scores[2] > scores[3] == scores[4]


def test_toxicity_held_out_and_odd_rows(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = op7_toxicity(spark, folder).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    hit = sum(r["predicted"] for r in held if labels[r["doc_id"]] == 1)
    wrong = sum(r["predicted"] for r in held if labels[r["doc_id"]] == 0)
    assert hit >= 0.8 * sum(labels[r["doc_id"]] for r in held) and wrong <= 0.02 * len(held)
    no_labels = spark.createDataFrame([], "doc_id long, toxic int")
    prior = toxicity.train(frame(spark, ODD), no_labels)
    odd = toxicity.toxicity(frame(spark, ODD), prior).collect()
    assert len(odd) == len(ODD) and {r["predicted"] for r in odd} == {0}
    assert toxicity.toxicity(frame(spark, []), prior).count() == 0


def brute_base(text):
    rules = [
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
        ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32),
    ]
    return [
        (kind, *m.span()) for kind, rule, group, least in rules
        for m in re.finditer(rule, text, re.ASCII | (re.IGNORECASE if kind == "assign" else 0)) if len(m.group(group)) >= least
    ]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(
    ["password", "Token", "api_key", "API", "KEY", "=", ": ", '"', "'", " ", "abcdef12", "AKIA", "ABCDEFGH1234", "deadbeef" * 4, "é", "\n", "ſecret", "x"]
), max_size=12).map("".join))
def test_base_spans_match_brute_force(text):
    assert sorted(secret_scan.base_spans(text)) == sorted(brute_base(text))


def test_novel_strings_are_reported_and_identifiers_are_not(spark):
    key = "9fK2lQz81Xw0Pb7RtUe4Yh"
    texts = {
        1: f"some code here\nAuthorization: Bearer {key}\nmore", 2: "the secret client_id_and_client_secret_2 is a name",
        3: f"nothing sensitive here {key}", 4: None, 5: "password = hunter2hunter2",
    }
    rows = {r["doc_id"]: r for r in secret_scan.secrets(frame(spark, [*texts.items(), (6, "x" * 200_000)])).collect()}
    at = texts[1].index(key)
    assert rows[1]["spans"] == f"novel:{at}:{at + len(key)}" and rows[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert rows[2]["spans"] == rows[3]["spans"] == rows[4]["spans"] == rows[6]["spans"] == ""
    assert rows[5]["spans"] == "assign:0:25" and rows[5]["n_assign"] == 1
    assert len(secret_scan.secrets(frame(spark, ODD)).collect()) == len(ODD)
    assert secret_scan.secrets(frame(spark, [])).count() == 0


def test_secret_scan_of_long_texts_is_linear():
    """Candidates are the first runs behind a sensitive word, as a search from each word finds them."""
    import time

    def searched(text):
        found, last = [], 0
        for word in secret_scan.SENSITIVE.finditer(text):
            stop = text.find("\n", word.end(), word.end() + secret_scan.CONTEXT)
            stop = word.end() + secret_scan.CONTEXT if stop < 0 else stop
            at = max(word.end(), last)
            while (m := secret_scan.CANDIDATE.search(text, at)) and m.start() <= stop:
                at = last = m.end()
                before, after = text[max(0, m.start() - secret_scan.WINDOW) : m.start()], text[m.end() : m.end() + secret_scan.WINDOW]
                if secret_scan.novelty(m.group(), before, after) >= secret_scan.NOVELTY * secret_scan.random_novelty(m.group(), before, after):
                    found.append(("novel", *m.span()))
        return found

    rnd = random.Random(17)
    for _ in range(25):
        parts = ["token", "secret=", "a word", "\n", "x" * 15, "bearer ", "client_id_and_more_of_it", ". "]
        text = "".join(rnd.choice([*parts, "".join(rnd.choices("abcXYZ019+/", k=rnd.randint(10, 40)))]) for _ in range(40))
        assert secret_scan.novel_spans(text, []) == searched(text)
    start = time.perf_counter()
    assert secret_scan.scan("the token is a word here. " * 200_000)[3] == 0
    assert time.perf_counter() - start < 20
    assert secret_scan.scan("the token is a word here. " * 1000 + "bearer q7Z+x2Lk9/Wm4Tr8Vb1N")[5] == "novel:26007:26027"


@pytest.mark.parametrize("letters", ["0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789"])
@pytest.mark.parametrize("length", [16, 64, 128, 300])
def test_random_keys_of_any_alphabet_and_length_are_reported_whole(letters, length):
    rnd = random.Random(length)
    found = 0
    for _ in range(20):
        text = f'x = 1\nclient_id = "{"".join(rnd.choices(letters, k=length))}"\n'
        found += secret_scan.novel_spans(text, []) == [("novel", 19, 19 + length)]
    assert found >= 19


def test_pipeline_against_its_parts(spark, folder):
    import corpus_pipeline

    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "simhash", "decontamination", "bpe"]
    rows = corpus_pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, folder)
        assert left.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in left.collect()}
    assert {r["doc_id"] for r in rows} == texts.keys()
    assert len({t.lower() for t in texts.values()}) == len(texts)
    items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert not any(item in t for t in texts.values() for item in items)
