"""Pages, chats, decontamination, packing and licences."""

from __future__ import annotations

import hashlib
import random
import re
import textwrap
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspan.llm import chat, decontaminate, html_extract, licenses, packing

from tests.llm.conftest import documents

PROSE = "Some sentences about a subject, long enough to look like prose, go here and go on for a while."


def page(article, before="", after=""):
    menu = "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(6))
    return (f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul>{menu}</ul></nav>"
            f"{before}<article>{article}</article>{after}<footer>&copy; site</footer></body></html>")


@pytest.mark.parametrize("article, want", [
    (f"<h1>Title &amp; more</h1><p>{PROSE}</p><p>Short.</p>", ["Title & more", PROSE, "Short."]),
    (f"<p><b>Unclosed bold.<br><p>{PROSE}<p>Next\n\n  one", ["Unclosed bold.", PROSE, "Next one"]),
    (f"<p>{PROSE} a<br>b&nbsp;c &#233;</p><ul><li>One<li>Two</ul>", [f"{PROSE} a b c é", "One", "Two"]),
    (f"<p>{PROSE}</p><div class='comments'><p>First!</p></div><aside>Side</aside><form><input><label>Mail</label></form>", [PROSE]),
    (f"<p>{PROSE}</p><!-- <p>hidden</p> --><script>if (a < b) '<p>no</p>'</script><div id='ad-box'>Buy</div><p>{PROSE}", [PROSE, PROSE]),
])
def test_article_text(article, want):
    assert html_extract.extract(page(article, '<div class="ad">Buy now.</div>', '<div class="cookie-notice">We use cookies.</div>')) == "\n\n".join(want)


def test_article_without_an_article_element():
    body = "".join(f"<p>{PROSE} {i}</p>" for i in range(5))
    html = f"<html><body><div id='x'><ul><li><a href='/'>Home</a><li><a href='/b'>More</a></ul></div><div class='post'>{body}</div><div><a href='/c'>c</a> <a href='/d'>d</a></div></body>"
    assert html_extract.extract(html) == "\n\n".join(f"{PROSE} {i}" for i in range(5))


FIVE = "".join(f"<p>{PROSE} {i}</p>" for i in range(5))
FIVE_TEXTS = [f"{PROSE} {i}" for i in range(5)]
MENU = "<nav><ul>" + "".join(f'<li><a href="/{i}">Item {i}</a>' for i in range(30)) + "</ul></nav>"


@pytest.mark.parametrize("wrapper", ['div class="content with-sidebar"', 'div class="no-comments"', "form action='/'", 'div id="page-header"', "form", "aside", 'section class="widget"'])
@pytest.mark.parametrize("inner", [FIVE, f"<article>{FIVE}</article>", f'<div class="side">{FIVE}</div>'])
def test_a_name_does_not_leave_out_the_page(wrapper, inner):
    tag = wrapper.split()[0]
    html = f"<html><body>{MENU}<{wrapper}>{inner}<aside>Side</aside></{tag}><div class='related'><p>Related text.</p></div><form><label>Mail</label></form></body></html>"
    assert html_extract.extract(html) == "\n\n".join(FIVE_TEXTS)


@pytest.mark.parametrize("attributes", ['href="/the-hidden-valley"', 'title="Hidden treasures"', 'data-hidden="false"', "href=/x?id=comments", 'href="/x?id=comments"',
                                        "data-class='sidebar'", 'title="a > b" data-role=search', "class=a class=sidebar", "title='class=\"ad\"'"])
def test_only_real_attributes_are_judged(attributes):
    assert html_extract.extract(page(f"<p>{PROSE} <a {attributes}>Linked</a> words.</p><div {attributes}>Block.</div><p>{PROSE}")) == f"{PROSE} Linked words.\n\nBlock.\n\n{PROSE}"


@pytest.mark.parametrize("attributes", ["hidden", "HIDDEN=''", "x=1 hidden", 'title="t"hidden', "class = 'ad'", "class=ad", "id=comments", 'a="b"class="x sidebar"', 'style="display: none"', "aria-hidden=true"])
def test_real_attributes_are_judged(attributes):
    assert html_extract.extract(page(f"<p>{PROSE}</p><div {attributes}>Block.</div><p>{PROSE}")) == f"{PROSE}\n\n{PROSE}"


@pytest.mark.parametrize("body, want", [
    (f"Intro<br><div>{FIVE}</div>Outro <b>bold</b>.", ["Intro", *FIVE_TEXTS, "Outro bold."]),
    (f"Intro<br><div><p>{PROSE}</p></div>Outro", ["Intro", PROSE, "Outro"]),
    (f"<span>Intro</span><div>{FIVE}</div><a href='/'>Home</a> <a href='/b'>More</a>", ["Intro", *FIVE_TEXTS]),
    (f"<article>{FIVE}</article><article><p>{PROSE} x</p><p>{PROSE} y</p></article>{MENU}", [*FIVE_TEXTS, f"{PROSE} x", f"{PROSE} y"]),
    (f"{MENU}<div><article>{FIVE}</article></div><div><ul><li><a href='/'>Home</a></ul><article><p>{PROSE} x</p></article></div>", [*FIVE_TEXTS, f"{PROSE} x"]),
    (f"<div class='post'>{FIVE}<article><p>{PROSE} x</p><p>{PROSE} y</p><p>{PROSE} z</p><p>{PROSE} w</p><p>{PROSE} v</p><p>{PROSE} u</p></article></div>",
     [*FIVE_TEXTS, *[f"{PROSE} {c}" for c in "xyzwvu"]]),
    (f"<main>{FIVE}</main><div>{FIVE}</div>", [*FIVE_TEXTS, *FIVE_TEXTS]),
    (f"<app-root><div>{FIVE}</div>Outro</app-root>", [*FIVE_TEXTS, "Outro"]),
])
def test_no_text_that_reaches_the_threshold_is_lost(body, want):
    assert html_extract.extract(f"<html><body>{body}</body></html>") == "\n\n".join(want)


def test_names_that_leave_out_most_of_a_page_are_not_believed():
    parts = "".join(f'<div class="widget">{PROSE} {i}</div>' for i in range(5))
    assert html_extract.extract(f"<body>{MENU}{parts}</body>") == "\n\n".join(FIVE_TEXTS)


@pytest.mark.parametrize("html", [None, "", "   ", "<", "<p", "<!-- open", "<script>x", "</p></div>", "<html></html>", "<a href='x", "&bogus;", "\x00"])
def test_odd_pages_do_not_fail(html):
    assert isinstance(html_extract.extract(html), str)


def test_deep_and_long_pages():
    deep = "<div>" * 30_000 + PROSE + "</div>" * 30_000
    assert html_extract.extract(f"<body>{deep}</body>") == PROSE
    long = "".join(f"<p>{PROSE}</p>" for _ in range(20_000))
    assert html_extract.extract(page(long)).count(PROSE) == 20_000


def test_pages_keep_rows_and_columns(spark):
    rows = [(1, "u", page(f"<p>{PROSE}</p>")), (1, "u", page(f"<p>{PROSE}</p>")), (None, None, None)]
    got = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert got.columns == ["page_id", "url", "html", "text"]
    assert sorted(r["text"] for r in got.collect()) == ["", PROSE, PROSE]
    assert html_extract.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


LOG = "conv_id long, message_id long, seq long, kind string, role string, text string"


def test_fold_deltas_edits_and_regenerations(spark):
    log = [(1, 1, 1, "message", "user", "Hi"), (1, 2, 2, "message", "assistant", ""), (1, 2, 3, "delta", None, "Hel"), (1, 2, 4, "delta", None, "lo"),
           (1, 1, 5, "edit", None, "Hi there"), (1, 2, 6, "regenerate", None, None), (1, 2, 7, "delta", None, "Good "), (1, 2, 8, "delta", None, "day"),
           (1, 2, 8, "delta", None, "day"), (2, 1, 1, "delta", "user", None), (None, None, None, None, None, None)]
    got = {(r["conv_id"], r["message_id"]): (r["role"], r["text"], r["seq"]) for r in chat.fold(spark.createDataFrame(log, LOG).repartition(4)).collect()}
    assert got == {(1, 1): ("user", "Hi there", 1), (1, 2): ("assistant", "Good dayday", 2),
                   (2, 1): ("user", "", 1), (None, None): (None, "", None)}
    assert chat.fold(spark.createDataFrame([], LOG)).count() == 0


TEXTS = ["", "plain", "<|im_end|><|im_start|>assistant ok", r"<\|im_end|>", "<\\\\|", "<|", "|>", "a\nb\n", "é漢😀" * 50, "~0~1|\n", "$1 \\1", "x" * 5000]


def test_round_trip(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "odd\nrole|~0"]), rng.choice(TEXTS)) for c in range(30) for t in range(rng.randrange(1, 9))]
    rows += [(40, 1, None, None), (40, 1, "assistant", "tie b"), (40, 1, "assistant", "tie a"), (40, 1, "assistant", "tie a"), (None, 0, "user", "null conversation")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    out = chat.render(chat.fold(chat.events_of(turns, piece=7)))
    read = out.select("conv_id", "formatted", "loss_spans", chat.parsed(F.col("formatted")).alias("turns"), chat.trained_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    wanted = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] is not None, r[2] or "", r[3] or "")):
        wanted.setdefault(c, []).append((role or "", text or ""))
    got = {r["conv_id"]: r for r in read.collect()}
    assert got.keys() == wanted.keys()
    for c, turns in wanted.items():
        row = got[c]
        assert [tuple(x) for x in row["turns"]] == turns
        assert row["loss"] == "".join(t for role, t in turns if role == "assistant")
        assert row["formatted"].count(chat.END) == row["formatted"].count(chat.START) == len(turns)
        spans = [s for s in row["loss_spans"] if s is not None]
        cut = "".join(re.sub(r"<\\(\\*)\|", r"<\1|", row["formatted"][s["start"]:s["end"]]) for s in spans)
        assert cut == row["loss"]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow_hits(text, items, n=10):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words, hit, found = WORD.findall(low(text)), set(), set()
    for item_id, item in items:
        w = WORD.findall(low(item))
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            for at in range(len(words) - size + 1):
                if words[at:at + size] == w[k:k + size]:
                    hit.update(range(at, at + size))
                    if item_id is not None:
                        found.add(str(item_id))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_words", [decontaminate.BLOCK_WORDS, 200])
def test_decontamination_equals_brute_force(spark, block_words):
    rng = random.Random(4)
    vocabulary = ["alpha", "beta", "gamma", "délta", "x1", "zeta"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(8, 20)))) for i in range(12)] + [(12, "only three words"), (13, None), (14, "..."), (12, "only three words"), (None, "no id at all")]
    texts = []
    for _ in range(40):
        text = " ".join(rng.choices(vocabulary, k=rng.randrange(60)))
        item = rng.choice(items)[1]
        texts.append(f"{text} {item.replace(' ', ', ').replace('a', 'A')} tail" if item and rng.random() < .6 else text)
    texts += [None, "", "ONLY  three\nwords", "with no id at all here", "only three"]
    docs = documents(spark, list(enumerate(texts))).withColumn("words", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r["hits"] for r in decontaminate.with_hits(docs, bench, block_words=block_words).collect()}
    for i, t in enumerate(texts):
        assert (got[i]["n_words"], got[i]["n_hit"], list(got[i]["items"])) == slow_hits(t, items), t
    clean = [i for i, t in enumerate(texts) if slow_hits(t, items)[1] == 0]
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()) == clean
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, bench, "spans").collect()}
    assert cut[clean[0]] == texts[clean[0]] and cut[len(texts) - 3] == "" and cut[len(texts) - 2] == "with  here"


def test_decontamination_of_nothing(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(documents(spark, [(1, "a b")]), bench).count() == 1
    assert decontaminate.decontaminate(documents(spark, []), bench).count() == 0


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(decontaminate, "_PIECE", 7)
    grams = decontaminate.Grams([("1", "one two three four five six seven eight nine ten")], 10)
    ids = grams.ids("zero one two three four five six seven eight nine ten eleven")
    assert grams.hits(ids) == ([1, 11], {"1"})


def slow_best_fit(lengths, window):
    open_windows = []
    for length in sorted(lengths, reverse=True):
        fits = [w for w in open_windows if w[0] >= length]
        if fits:
            best = min(fits, key=lambda w: w[0])
        else:
            open_windows.append(best := [window])
        best[0] -= length
    return sorted(w[0] for w in open_windows)


def test_words_are_encoded_without_marks():
    """New words of letters cost one word each, and what a word turns into changes no other's ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    encoder, seen = packing.Encoder(), []
    encode = encoder.encode
    encoder.encode = lambda texts, **options: seen.extend(texts) or encode(texts, **options)
    text = "Quixotry zebra \u03a3\u03af\u03c3\u03c5\u03c6\u03bf\u03c2 \u0442\u0435\u0441\u0442 qqqxw"
    assert encoder.ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert seen == [text]
    for odd in ("\u0130stanbul zebra", "\u0958\u0958 other words", "don't it's a1b2 x\u0302y ` ``", "<|endoftext|> nnn <|ENDOFTEXT|>", "\uf900 \u1e9e \u01c5 fine"):
        assert encoder.ids(odd).tolist() == plain.encode(odd, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(5))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    lengths = [min(64, int(rng.expovariate(1 / 12)) + 1) for _ in range(rng.randrange(1, 400))]
    counts = {x: lengths.count(x) for x in set(lengths)}
    rows = packing.plan(counts, 64)
    fill, places = {}, {}
    for length, first, n, window, offset in rows.tolist():
        assert first == places.get(length, 0)
        places[length] = first + n
        for w in range(window, window + n):
            fill.setdefault(w, []).append((offset, length))
    assert places == counts
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(64 - sum(x for _, x in p) for p in fill.values()) == slow_best_fit(lengths, 64)


def test_encoder_equals_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    encoder = packing.Encoder()
    for text in ["", " ", "Hello  world\n\nit's 42!!", "É́ ﬁ ǅ İstanbul", "a\tb c d\x1ce\x85f", "<|endoftext|> <|startoftext|>x", "x" * 3000, "漢字😀 ok", "don't can't I'LL"]:
        assert encoder.ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("texts", [["a \u1fef b"], ["\u1fef"], ["x\u1fefy one two"], ["one \u1fef two ` three"], ["` \u1fef", "later words é"], ["`\u0300 e\u0301 `` a`b"]])
def test_encoder_with_characters_that_become_the_stop(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    got = [ids.tolist() for ids in packing.Encoder().many(texts)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_when_the_stops_do_not_add_up(monkeypatch):
    texts = ["one two three", "two red"]
    want = [ids.tolist() for ids in packing.Encoder().many(texts)]
    encoder = packing.Encoder()
    encoder.stop = int(encoder.ids("red")[0])
    encoder.forget()
    assert [ids.tolist() for ids in encoder.many(texts)] == want


def test_pack(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["red", "green", "blueish"], k=rng.randrange(40)))) for i in range(60)] + [(7, "red"), (7, "red"), (None, None), (99, "red " * 700)]
    docs = documents(spark, rows).withColumn("offset", F.lit(0)).repartition(3)
    pieces = packing.pack(docs, window=64, with_ids=True, buckets=3)
    got = pieces.collect()
    encoder = packing.Encoder()
    want = sorted((i is None, i or 0, np.append(encoder.ids(t or ""), 2).astype("<u4").tobytes()) for i, t in rows)
    at = {}
    for r in sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["start"])):
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    assert sum(r["length"] for r in got) == sum(len(w[2]) // 4 for w in want)
    long = sorted((r for r in got if r["doc_id"] == 99), key=lambda r: r["start"])
    assert b"".join(r["ids"] for r in long) == next(w[2] for w in want if w[1] == 99) and [r["length"] for r in long[:-1]] == [64] * (len(long) - 1)
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(at) == list(range(len(at))) and max(at.values()) <= 64
    for r in packing.sequences(pieces, window=64).collect():
        assert len(r["ids"]) // 4 == packing.padded_length(at[r["sequence_id"]], 64)
    assert packing.pack(documents(spark, [])).count() == 0


def test_padding_except_at_a_power_of_two():
    assert [packing.padded_length(n) for n in (1, 3, 1024, 1025, 4096)] == [1, 4096, 1024, 4096, 4096]


def test_known_sentences_are_normalised_and_signalled(spark):
    rows = spark.createDataFrame([(k, s) for k, s in licenses.SENTENCES.items()], "id string, text string")
    got = rows.select("id", "text", licenses.normalised(F.col("text")).alias("n"), F.col("text").rlike(licenses.SIGNALS).alias("s")).collect()
    assert [r["id"] for r in got if r["n"] != r["text"] or not r["s"]] == []
    assert {i for _, wanted in licenses.RULES for i in wanted} <= licenses.SENTENCES.keys()


MIT = """The MIT License (MIT)

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def test_licences(spark):
    texts = [MIT, "Some text.\nLicensed under the Apache License, Version 2.0.\nmore", "Released under the MIT License. Licensed under CC BY-NC 4.0.",
             "This work is licensed under the GNU General Public License, version 3.", "no licence here, but a licence is named", None, "", "Licensed under the Apache License, Version 2.0" + " x" * 100_000]
    docs = documents(spark, list(enumerate(texts))).withColumn("Licences_", F.lit(1))
    got = {r["doc_id"]: (list(r["sentence_ids"]), list(r["licences"])) for r in licenses.scan(docs).collect()}
    assert got[0][0] == ["mit-title", "mit-grant", "mit-notice", "as-is", "no-liability"]
    assert [got[i][1] for i in range(8)] == [["MIT"], ["Apache-2.0"], ["CC-BY-NC-4.0", "MIT"], ["GPL-3.0"], [], [], [], []]
    assert licenses.scan(documents(spark, [])).count() == 0


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
BSD = """Copyright (c) 2020, A. Holder
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ENDORSE = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


@pytest.mark.parametrize("before", ["", "# ", " * ", "// ", "rem ", "    "])
def test_wrapped_licences(spark, before):
    mit = "\n\n".join(textwrap.fill(p, 76) for p in MIT.split("\n\n")[1:])
    glued = "Copyright (c) 2020 A. Holder\n" + mit
    isc = textwrap.fill("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, "
                        "provided that the above copyright notice and this permission notice appear in all copies.", 60)
    gpl2 = GPL.replace("software: you", "software; you").replace("version 3", "version 2")
    texts = [mit, glued, APACHE, APACHE.replace("\n", "\r\n"), BSD, BSD + ENDORSE, GPL, gpl2, isc, "Not released under the\nMIT License, that is", "released under the\n\nMIT License", "released under the. MIT License"]
    rows = [(i, "\n".join(before + line for line in t.split("\n"))) for i, t in enumerate(texts)]
    got = {r["doc_id"]: (list(r["sentence_ids"]), list(r["licences"])) for r in licenses.scan(documents(spark, rows)).collect()}
    licences = [got[i][1] for i in range(9)]
    assert licences == [["MIT"], ["MIT"], ["Apache-2.0"], ["Apache-2.0"], ["BSD-2-Clause", "Proprietary"], ["BSD-3-Clause", "Proprietary"], ["GPL-3.0"], ["GPL-2.0"], ["ISC"]]
    assert got[0][0] == got[1][0] == ["mit-grant", "mit-notice", "as-is", "no-liability"]
    assert got[2][0] == ["apache-line", "apache-may-not", "apache-copy", "apache-basis", "apache-see"]
    assert [got[i][0] for i in (9, 10, 11)] == [[], [], []]


def test_rules_are_ordered(spark):
    rows = spark.createDataFrame([(["bsd-grant", "x", "bsd-source", "bsd-binary"],), (["bsd-binary", "bsd-source", "bsd-grant"],),
                                  (["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"],)], "ids array<string>")
    assert [r[0] for r in rows.select(licenses.licences_of(F.col("ids"))).collect()] == [["BSD-2-Clause"], [], ["BSD-3-Clause"]]


def test_digests_of_the_query(spark, tmp_path):
    from veilspan.llm.queries import op2_chat

    spark.createDataFrame([(3, 0, "user", None), (3, 1, "assistant", "a<|b")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in op2_chat(spark, str(tmp_path)).collect()}
    told = "<|im_end|><|im_start|>assistant ok"
    assert got[-1]["turns_sha256"] == hashlib.sha256(f"user\n{told}\nassistant\n{told}\n".encode()).hexdigest()
    assert got[-1]["loss_chars"] == len(told) and got[-1]["loss_sha256"] == hashlib.sha256(told.encode()).hexdigest()
    assert got[3]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\na<|b\n").hexdigest() and got[3]["n_turns"] == 2


@pytest.mark.parametrize("html", [
    f"<html><body><p>Short one.</p></body>{FIVE}</html>", f"<html>{FIVE}<body><p>Short one.</p></body></html>", f"<html><body></body>{FIVE}</html>", FIVE,
    f"{FIVE}<body></body>", f"<head><title>T</title></head>{FIVE}<body><nav>Menu</nav></body>", f"<html><head></head>{FIVE}</html><p>Short one.</p>",
    f"<body><p>Short one.</body></html>{FIVE}"])
def test_content_outside_the_body_belongs_to_it(html):
    blocks = html_extract.extract(html).split("\n\n")
    assert [b for b in blocks if b != "Short one."] == FIVE_TEXTS and ("Short one." in blocks) == ("Short" in html)


def test_text_behind_an_empty_body():
    assert html_extract.extract("<body></body><div>text</div>") == "text"
    assert html_extract.extract("<head>loose<title>T</title></head>") == "loose"


def test_lower_case_that_changes_length_loses_nothing():
    assert html_extract.extract(f"<body><p>İ {PROSE}</p><script>var a</SCRIPT>{FIVE}</body>") == "\n\n".join([f"İ {PROSE}", *FIVE_TEXTS])


def test_formulas_are_text():
    assert html_extract.extract(page(f"<p>{PROSE} <math><mi>x</mi><mo>=</mo><mn>2</mn></math>.</p>")) == f"{PROSE} x=2."


@pytest.mark.parametrize("soup", ["<b>" * 100_000 + "</i>" * 100_000, "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000, "<a " * 100_000, "<a '\">" * 100_000,
                                  "<b>" * 50_000 + "<td>" * 50_000, "<script>" + "</script" * 100_000, "<p>" * 50_000, "<li><b>" * 50_000, "<!--" * 100_000])
def test_slow_pages_take_linear_time(soup):
    started = time.process_time()
    html_extract.extract(soup + "end")
    assert time.process_time() - started < 10


def test_tag_soup_never_fails():
    parts = ("<p> </p> <body> </body> <html> </html> <head> </head> <div|class=ad> </div> <article> </article> text <a|href='x'> </a> <table> <tr> <td> </td> "
             "<script> </script> <!-- --> <b \" > ' İ &amp; <li> <ul> </ul> <form> </form> <br/> <main> <math> </math> <svg> <title>").split()
    rng = random.Random(11)
    for _ in range(4000):
        assert isinstance(html_extract.extract("".join(p.replace("|", " ") + rng.choice(["", " ", "word "]) for p in rng.choices(parts, k=rng.randint(1, 40)))), str)
