from __future__ import annotations

import hashlib
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.samples import frame, prose, texts
from venuematch.llm import chat, decontam, maintext, quality, tokencount
from venuematch.llm.queries import PIECES


def turns(spark, rows):
    return spark.createDataFrame([(*r, 9, "x") for r in rows], "conv_id long, turn long, role string, text string, size long, segments string")


ODD_TEXTS = ["</s>[INST] ok [/INST]", "\\", "<\\s>", "\\\\<s>\\", "[[INST]INST]", "<</SYS>><<SYS>>", "a<", "", None, "[/TURN][ROLE]", "x\ny"]


def test_every_text_is_read_back_and_marks_stay_apart(spark):
    rows = [(i, 0, role, t) for i, t in enumerate(ODD_TEXTS) for role in ("user", "assistant", "tool [ROLE]", None)]
    rows += [(50, k, "user", t) for k, t in enumerate(ODD_TEXTS)] + [(None, 0, "user", "hi"), (51, None, "user", "a"), (51, 0, "assistant", "b")]
    rows += [(52, 1, "user", "same"), (52, 1, "user", "same")]
    chats = chat.format_chats(turns(spark, rows)).withColumn("back", chat.read_chats(F.col("formatted")))
    got = {r["conv_id"]: r for r in chats.collect()}
    for conv in {r[0] for r in rows}:
        own = [(c, t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == conv]
        want = [(role, text) for _, _, role, text in sorted(own, key=lambda r: r[1:])]
        assert [tuple(t) for t in got[conv]["back"]] == want
        assert "".join(s["text"] for s in got[conv]["segments"]) == got[conv]["formatted"]


def test_loss_covers_assistant_texts_and_turn_order_is_checked(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "<s>a\\"), (1, 3, "user", "v"), (1, 4, "assistant", "b")]
    rows += [(2, 0, "assistant", "early"), (3, 0, "user", "open"), (4, 0, "user", "q"), (4, 1, "robot", "r")]
    chats = chat.format_chats(turns(spark, rows)).withColumn("loss", chat.loss_text(F.col("segments")))
    got = {r["conv_id"]: (r["loss"], r["valid"]) for r in chats.collect()}
    assert got == {1: ("<s>a\\b", True), 2: ("early", False), 3: ("", False), 4: ("", False)}
    assert chat.format_chats(turns(spark, rows).limit(0)).count() == 0


def test_a_template_needs_marks_that_can_be_told_apart():
    with pytest.raises(ValueError):
        chat.ChatTemplate({"user": chat.RoleForm("<u>", "<u>")})
    with pytest.raises(ValueError):
        chat.ChatTemplate({"user": chat.RoleForm("<u>", "x<u>")})


ARTICLE = "<article><h1>Title &amp; more</h1><p><b>First  line<br><p>Second &lt;line&gt; of\n the text.</article>"


@pytest.mark.parametrize("before", [
    "<nav><ul><li><a href=x>Home</a></ul></nav>", "<header><h2>Site name here</h2></header>", '<div class="ad">Buy our fine goods now please</div>',
    '<div id="cookie-notice"><div><p>We use cookies on this site</p></div></div>', "<script>var t='</p>';if(a<b){words()}</script>", "",
])
@pytest.mark.parametrize("after", [
    "<footer>&copy; words of a footer</footer>", '<section class="comments"><p>I liked this text a lot, thank you</p></section>',
    "<aside>Other things to read</aside>", "<form><label>Your name</label><input></form>", "",
])
def test_only_the_article_is_extracted(before, after):
    page = f"<html><head><title>Title</title><style>p{{}}</style></head><body>{before}{ARTICLE}{after}</body></html>"
    assert maintext.START.extract(page) == "Title & more\nFirst line\nSecond <line> of the text."


def test_regions_without_a_main_element_and_odd_pages():
    page = '<body><div id="menu"><a>Home</a> <a>About</a></div><div><h1>Head</h1><p>Some text of <a>a link</a> here.<ul><li>One<li>Two</ul></div><div class="sidebar">x y z</div>'
    assert maintext.START.extract(page) == "Head\nSome text of a link here.\nOne\nTwo"
    for odd in (None, "", "<", "<<<>>>", "<p", "<!-- open", "<script>never closed", "</p></div>"):
        assert isinstance(maintext.START.extract(odd), str)
    assert maintext.START.extract("just words") == "just words"
    assert maintext.START.extract("<div class='ad'>unclosed <article><p>real words here</article>") == "real words here"


@pytest.mark.parametrize("wrapper", ["<form action=x>", "<div class='has-sidebar'>", "<div class='content-sidebar-wrap'>", "<div class='widget-area main'>", "<div role=form>"])
def test_wrappers_of_the_page_are_read(wrapper):
    close = f"</{wrapper[1:].split()[0].strip('>')}>"
    aside = "<div class='sidebar'>Some other words that are on every page of this site and are longer than the rest of it</div>"
    page = f"<body><h2>A line</h2>{wrapper}{aside}{ARTICLE}<form><label>Your name</label></form>{close}<p>Imprint</p></body>"
    assert maintext.START.extract(page) == "Title & more\nFirst line\nSecond <line> of the text."
    plain = f"<body><h2>A line</h2>{wrapper}<p>{'words of the text ' * 9}</p><div class='related'>x y</div>{close}</body>"
    assert maintext.START.extract(plain).endswith("words of the text " * 8 + "words of the text")


def test_weights_are_learnt_from_marked_pages():
    pages = [f"<body><q7>{'junk ' * 3}</q7><main><p>{'good ' * n}</p><x9>mid</x9><p>tail</p></main></body>" for n in range(2, 9)]
    model = maintext.learnt(pages)
    assert all(w < 0 for k, w in model.weights.items() if "word" not in k)
    assert all(model.extract(p).endswith("mid\ntail") for p in pages)


@pytest.mark.parametrize("page, want", [
    ("<article><p>Der Artikel ist kurz.</p></article><div class='kommentare'><p>{long}</p></div>", "Der Artikel ist kurz."),
    ("<article><p>Der Artikel ist kurz.</p></article><div class='xyz'><p>{long}</p></div>", "Der Artikel ist kurz."),
    ("<main><article><p>First one.</p></article><article><p>Second one.</p></article></main><p>{long}", "First one.\nSecond one."),
    ("<main><h1>Head</h1><article><p>A b c d.</p></article><div class=x1><p>e f</p></div></main>", "Head\nA b c d."),
    ("<article><p>One.</p><section class='social'><p>On social policy.</p></section><p class='alert'>Read this.</p><p>Two.</p></article>", "One.\nOn social policy.\nRead this.\nTwo."),
    ("<article><p>One.</p><div class='ad-box'>{long}</div><p>Two.</p><section id=comments>{long}</section></article>", "One.\nTwo."),
    ("<div role=main><p>One two.</p></div><div><p>{long}</p></div>", "One two."),
    ("<article><ul><li class=share>a<li>b</ul><p class=newsletter>c<p>d<table><tr><td class=ads>e<td>f<tr><td>g</table></article>", "b\nd\nf\ng"),
    ("<article><p title='a > b'>One</p><!-- <p>no --><p>t&wo;&nbsp;&amp;  3</p></article>", "One\nt&wo; & 3"),
    ("<article>" + "<img src=x><span></span>" * 40 + "<p>One.</p>" + "<img src=x>" * 200 + "<p>Two.</p></article>", "One.\nTwo."),
])
def test_the_marked_main_element_is_taken_whole(page, want):
    assert maintext.START.extract(page.replace("{long}", "many more words than that " * 20)) == want


@pytest.mark.parametrize("odd", ["<nav><p>word here", "<div class=ad>", "<a ", "<a '", '<a ">" ', "<![CDATA[", "<title>x", "<li><ul>", "<p><b> ", "<form><p>a b", "<svg ", "x<", "<main>"])
def test_odd_pages_take_time_in_proportion(odd):
    def seconds(n):
        began = time.process_time()
        assert isinstance(maintext.START.extract(odd * n), str)
        return time.process_time() - began

    # Sixteen times the page would take 256 times as long if places were searched again.
    assert seconds(16 * 1500) < 80 * max(0.01, min(seconds(1500) for _ in range(3)))


def test_the_scan_finds_the_greatest_sum():
    rng = random.Random(4)
    for _ in range(300):
        tokens = [(k, rng.randrange(1, 4) if "word" in k else 0) for k in rng.choices(["word", "link word", "p", "div", "q7"], k=rng.randrange(0, 14))]
        within = None
        if rng.random() < 0.5:
            within = tuple(sorted(rng.randrange(0, len(tokens) + 1) for _ in range(2)))
        start, stop = within or (0, len(tokens))
        one = lambda t: maintext.START.weight(t) if t[1] or within is None else 0.0
        total = lambda a, b: sum(one(t) for t in tokens[a:b])
        first, end = maintext.START.region(tokens, within)
        best = max((total(a, b) for a in range(start, stop + 1) for b in range(a, stop + 1)), default=0)
        assert start <= first <= end <= stop and abs(total(first, end) - best) < 1e-9


def test_what_class_words_say_is_learnt():
    box = "<div class='teaser-box'><p>other things</p></div>"
    marked = [f"<body>{box}<article><h2 class='social'>On</h2><p>{'good ' * n}</p></article>{box}</body>" for n in range(20, 60)]
    page = f"<body>{box}<div><h2 class='social'>On</h2><p>{'good ' * 9}</p></div>{box}</body>"
    model = maintext.learnt(marked)
    assert model.extract(page) == "On\n" + ("good " * 9).strip()
    assert maintext.START.extract(page) != model.extract(page)
    # In a marked main element nothing is passed over for a word that was learnt.
    assert model.extract(f"<article><p>One.</p>{box}</article>") == "One.\nother things"


def test_main_text_rows(spark):
    rows = [(1, "u", ARTICLE, "t"), (1, "u", ARTICLE, "t"), (2, None, None, "t"), (None, "v", "", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"] or 0, r["n_chars"]) for r in maintext.main_text(pages).collect()))
    n = len("Title & more\nFirst line\nSecond <line> of the text.")
    assert got == [(0, 0), (1, n), (1, n), (2, 0)]
    assert maintext.main_text(pages.limit(0)).count() == 0


def library_counts(vocabulary, given):
    from tokenizers import Tokenizer, models, pre_tokenizers

    found = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary], unk_id=0, byte_fallback=False))
    found.pre_tokenizer = pre_tokenizers.Metaspace(replacement=tokencount.SPACE, prepend_scheme="always", split=True)
    return [len(x.ids) for x in found.encode_batch(given)]


def test_token_counts_agree_with_the_library(spark):
    rng = random.Random(3)
    given = [t or "" for _, t in texts()] + ["", " ", "  ", "a  b", " x", "日本語語 ab", "▁ a", "a▁b", "ÿþ✓✓ ✓", "zz✓q\n\nz "]
    counter = tokencount.Counter(tokencount.unigram_vocabulary(PIECES), keep=50)
    assert [counter.count(t) for t in given] == library_counts(tokencount.unigram_vocabulary(PIECES), given)
    # Equal scores everywhere, so that ties decide.
    tied = [("".join(rng.choice("ab▁") for _ in range(rng.randrange(1, 4))), -1.0) for _ in range(12)]
    tied = list(dict(tied).items())
    given = ["".join(rng.choice("abc ") for _ in range(30)) for _ in range(200)]
    counter = tokencount.Counter(tied)
    assert [counter.count(t) for t in given] == library_counts(tied, given)


def test_token_count_rows(spark):
    got = {(r["doc_id"], r["n_tokens"]) for r in tokencount.token_counts(frame(spark), PIECES).collect()}
    counter = tokencount.Counter(tokencount.unigram_vocabulary(PIECES))
    assert got == {(d, counter.count(t)) for d, t in texts()}
    assert tokencount.token_counts(frame(spark).limit(0), PIECES).count() == 0


ITEM = "Anna has 12 apples and gives 5 of them to her friend Berta in the village near the river before noon today."
OTHER = "Nobody asked which of the seven old bridges could be crossed twice without ever turning around on the way home again."


def test_verbatim_and_reparameterised_questions_are_found(spark):
    rng = random.Random(2)
    wrap = lambda t: f"{prose(rng, 30)} {t} {prose(rng, 30)}"
    docs = {
        1: wrap(ITEM), 2: wrap(ITEM.replace("Anna", "Clara").replace("12", "340").replace("Berta", "Dora")), 3: wrap(OTHER.upper()),
        4: prose(rng, 200), 5: wrap(" ".join(OTHER.split()[:6])), 6: wrap(OTHER.replace("bridges", "bridges***")),
        7: wrap("Anna has 12 apples and gives 5 of them"), 8: wrap(f"{ITEM} {OTHER}"), 9: None, 10: "",
    }
    items = [(1, ITEM, "a"), (2, OTHER, "b"), (7, OTHER, "c"), (3, "too short to tell", "d"), (4, None, "e"), (None, "", "f")]
    benchmark = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    rows = [*docs.items(), (1, docs[1])]
    got = {(r["doc_id"], r["item_id"]): r["same_values"] for r in decontam.contaminated(frame(spark, rows), benchmark).collect()}
    assert got == {(1, 1): True, (2, 1): False, (3, 2): True, (6, 2): True, (8, 1): True, (8, 2): True}
    left = decontam.without_benchmark(frame(spark, rows), benchmark)
    assert {r["doc_id"] for r in left.collect()} == {4, 5, 7, 9, 10} and left.columns == frame(spark).columns
    assert decontam.contaminated(frame(spark).limit(0), benchmark).count() == 0
    assert decontam.contaminated(frame(spark), benchmark.limit(0)).count() == 0


def test_inconsistent_slots_are_no_match(spark):
    item = "Anna met Berta and Anna told Berta that Anna saw 4 of the 4 very old trees near her house"
    same = item.replace("Anna", "Clara").replace("Berta", "Dora")
    mixed = "Clara met Dora and Emma told Fiona that Greta saw 4 of the 4 very old trees near her house"
    docs = spark.createDataFrame([(1, f"so {same}"), (2, f"so {mixed}")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, f"so {item}")], "item_id long, text string")
    assert {r["doc_id"] for r in decontam.contaminated(docs, benchmark).collect()} == {1}


def found_pairs(spark, docs, items):
    """{(document, item): same_values}, both numbered from 0."""
    numbered = lambda texts, key: spark.createDataFrame(list(enumerate(texts)), f"{key} long, text string")
    got = decontam.contaminated(numbered(docs, "doc_id"), numbered(items, "item_id")).collect()
    return {(r["doc_id"], r["item_id"]): r["same_values"] for r in got}


def test_numbers_inside_words_are_slots(spark):
    item = "how many patients with covid-19 were treated at n=100 and had x+3 days off at US$5 each"
    docs = [f"so {item} then", f"so {item.replace('19', '21').replace('100', '250')} then", "how many patients with covid-19 were well"]
    assert found_pairs(spark, docs, [item]) == {(0, 0): True, (1, 0): False}


def test_names_at_any_place_and_in_any_case_are_found(spark):
    item = "Anna has 12 apples. Berta gives Anna 5 more apples. How many apples does Anna have now?"
    other = item.replace("Anna", "Clara").replace("Berta", "Dora")
    german = "Der Bauer gibt dem Kind am Morgen drei Eier und holt am Abend aus dem Dorf wieder Brot und Wein für die Gäste"
    two = "Anna Schmidt has 12 apples and gives 5 to her friend in the old village near the river"
    docs = [f"so it goes. {other}", f"so {german.lower()}", f"so {german.upper()}", f'he read "{two.replace("Anna Schmidt", "Dora Lee Miller").replace("12", "40").replace("5 to", "6 to")}"']
    found = found_pairs(spark, docs, [item, german, two])
    assert found == {(0, 0): False, (1, 1): True, (2, 1): True, (3, 2): False}


def test_one_slot_does_not_hide_a_passage(spark):
    item = f"they walk 5 km to the lake and then 5 km back to the old house where their mother waits. {OTHER} so 7 of 9 were left"
    changed = item.replace("5 km back", "6 km back")
    equal = item.replace("7 of 9", "9 of 9")
    both = changed.replace("7 of 9", "3 of 3").replace("seven", "eight").replace("walk 5", "walk 8")
    docs = [f"so {changed}", f"so {equal}", f"so {both}"]
    assert {d for d, _ in found_pairs(spark, docs, [item])} == {0, 1, 2}
    words = [f"{a}{b}" for a in "bcdfghklmn" for b in ("ab", "ed", "on", "ul")]
    numbered = lambda values: " ".join(f"{w} {values[i // 5]}" if i % 5 == 4 else w for i, w in enumerate(words))
    docs = [numbered([11, 21, 21, 31, 41, 51, 61, 71]), numbered([11, 21, 31, 31, 21, 21, 31, 31])]
    assert found_pairs(spark, docs, [numbered([1, 1, 2, 3, 4, 5, 6, 7])]) == {(0, 0): False}


def test_short_items_are_found_as_a_whole(spark):
    items = ["Who crossed the seven bridges?", "What is the capital city of the oldest known river kingdom?", "How many legs have 3 spiders?"]
    docs = [f"Question: {x}" for x in items] + [f"A heading line\n{x}" for x in items]
    docs += ["so how many legs have 12 spiders", "who crossed the seven rivers", "the capital city of the oldest known river kingdom", ""]
    found = found_pairs(spark, docs, items)
    assert found == {(i, i % 3): True for i in range(6)} | {(6, 2): False}


def test_tiny_items_are_found_as_a_line_or_sentence_only(spark):
    items = ["Yes", "42 km", "Paris, France", "Is this it?"]
    docs = ["Yes", "well yes of course", "First.\nYes.\nLast", "It took a while. Yes! So it was", "he ran 42 km today", "One\n 42 km \ntwo", "So is this it? No", "a\nis this it?\nb", ""]
    assert {d: i for d, i in found_pairs(spark, docs, items)} == {0: 0, 2: 0, 3: 0, 5: 1, 7: 3}


def runs_of_template_words(spark, docs, known):
    """Documents that hold a window, by marking all of them."""
    texts = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    short = sorted({r["item_words"] for r in known.collect() if r["item_words"] < decontam.WINDOW})
    marked = decontam._windowed(texts, ["doc_id"], decontam.WINDOW, short)
    met = decontam._windows(marked, ["doc_id", "form"], decontam.WINDOW, short).join(known, ["form", "hash"])
    return {r["doc_id"] for r in met.select("doc_id").distinct().collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_no_text_with_a_window_is_passed_over(spark, seed):
    rng = random.Random(seed)
    words = ["the", "Anna", "berta", "5", "12,5", "km", "5km", "%", "covid-19", "n=100", "don't", "end.Next", "-", "...", "US$5", "e\u0301", "ΟΔΟΣ", "οδος",
             "ǅ", "Ⅷ", "Ⓐb", "5%of", "10mi/5km", "a\ue000b", "O'Neil", "\u00a0x", "x\u00a0", "of", "(5)", "kg.", "5\n", "\"Who", "STRASSE", "straße", "İx", "1st"]
    ends = [" ", " ", " ", "  ", "\n", ", ", ". ", "\t"]
    text = lambda n: "".join(rng.choice(words) + rng.choice(ends) for _ in range(n))
    items = [text(rng.randrange(4, 24)) for _ in range(12)]
    changed = lambda t: rng.choice([str, str.upper, str.lower, str.title])(t)
    docs = [text(rng.randrange(1, 6)) + changed(rng.choice(items)) + text(rng.randrange(1, 6)) for _ in range(150)]
    docs += [text(rng.randrange(1, 40)) for _ in range(150)] + [prose(rng, 60) for _ in range(50)]
    known = decontam.benchmark_windows(spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    known = known.filter(F.col("item_words") >= decontam.MIN_WORDS).cache()
    texts = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    passed = {r["doc_id"] for r in decontam.passing(texts, known).select("doc_id").collect()}
    held = runs_of_template_words(spark, docs, known)
    assert len(held) > 50 and held <= passed and not passed & set(range(300, 350))


def test_the_filters_are_no_part_of_the_plan(spark):
    """A plan is kept by the driver, several times over, so its length may not follow the benchmark's."""

    def length(items):
        rng = random.Random(5)
        benchmark = spark.createDataFrame([(i, prose(rng, 30)) for i in range(items)], "item_id long, text string")
        found = decontam.contaminated(frame(spark), benchmark)
        return len(re.sub(r"\d+", "", found._jdf.queryExecution().toString()))

    assert abs(length(60) - length(2)) < 200


def test_only_the_contaminated_text_of_an_id_goes(spark):
    docs = frame(spark, [(None, f"so {OTHER}"), (None, "a clean text"), (5, f"so {OTHER}"), (5, "another clean text")])
    benchmark = spark.createDataFrame([(1, OTHER)], "item_id long, text string")
    left = decontam.without_benchmark(docs, benchmark).collect()
    assert sorted(r["text"] for r in left) == ["a clean text", "another clean text"]


def labelled(spark, n=400):
    rng = random.Random(4)
    rows = [(i, prose(rng, 60) if i % 3 else " ".join(f"{w}$$$" for w in prose(rng, 40).split())) for i in range(n)]
    docs = frame(spark, [*rows, (None, "x"), (n, None), (n + 1, ""), (0, rows[0][1])])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(n)] + [(5, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_classifier_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    got = quality.classified(docs, labels).collect()
    assert len(got) == 404 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 400]
    assert len(held) > 100 and all(r["predicted"] == (r["doc_id"] % 3 > 0) for r in held)
    kept = quality.good_only(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] % 3 for r in kept.filter("doc_id < 400").collect()} == {1, 2}


def test_classifier_without_labels(spark):
    docs, labels = labelled(spark, 20)
    assert {r["score"] for r in quality.classified(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classified(docs.limit(0), labels).count() == 0


def test_tables_are_bounded_and_deterministic():
    rng = np.random.default_rng(0)
    x = rng.random((300, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert ((model.scores(x) >= 0.5) == y).mean() > 0.9
    assert (quality.fit(x, y).scores(x) == model.scores(x)).all()


def test_digests_of_the_query_come_from_the_output(spark):
    from venuematch.llm.queries import op2_chat

    got = {r["conv_id"]: r for r in op2_chat(spark, "/root/testdata/sf0.001").collect()}
    text = "</s>[INST] ok [/INST]"
    assert got[-1]["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert got[-1]["loss_chars"] == len(text) and got[-1]["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert public_tokenizers.path("byte_bpe_50k.json")
