"""Media, language, HTML, licences and top-k against round trips, held-out accuracy and brute force."""

import hashlib
import html as entities
import math
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest

from palimpsest.llm import html, langid, licenses, media, topk
from palimpsest.llm.queries import queries

from .conftest import SF


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module", params=["docs", "odd", "empty"])
def given(request):
    df = request.getfixturevalue(request.param)
    return df, [(r["doc_id"], r["text"], r["source"]) for r in df.select("doc_id", "text", "source").collect()]


# -- media


def test_media_round_trip(given):
    df, docs = given
    got = rows(media.digests(media.store(df), ("doc_id", "n_bytes")))
    want = Counter()
    for d, t, _ in docs:
        p = (t or "").encode()
        p += bytes(-len(p) % 64 or 64 * (not p))
        want[d, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    text = {d: t or "" for d, t, _ in docs}
    seen = {}
    for r in got:
        own = (r["media_bytes"], r["media_sha256"], r["feature"])
        assert seen.setdefault(text[r["doc_id"]], own) == own
    assert len(set(seen.values())) == len(seen)


def test_any_coefficients_survive_and_batches_do_not_matter():
    rng = np.random.default_rng(5)
    payloads = [rng.integers(0, 256, 64 * n, dtype=np.uint8).tobytes() for n in (1, 2, 6, 7, 300, 1600)] + [bytes(64), bytes(64 * 13)]
    for share in (0.01, 0.05, 0.2, 0.6):
        values = (rng.random(64 * 90) < share) * rng.integers(-3, 4, 64 * 90)
        payloads.append(values.astype(np.int8).tobytes())
    files = media.encode(payloads)
    facts, found = media.coefficients(files)
    assert [media.payload_of(f, c) for f, c in zip(facts, found, strict=True)] == payloads
    together = [t.tobytes() for t in media.tensors(facts, found)]
    for f, p, t in zip(files, payloads, together, strict=True):
        assert media.encode([p]) == [f]
        assert next(media.tensors(*media.coefficients([f]))).tobytes() == t


def test_tensor_is_the_inverse_transform():
    c = np.zeros((6, 64), dtype=np.int8)
    c[0, 0], c[1, 5], c[2, 63], c[4, 0], c[5, 1] = 80, -60, 40, 100, 70
    facts, found = media.coefficients(media.encode([c.tobytes()]))
    got = next(media.tensors(facts, found)).astype(int)

    def samples(z):
        f = np.zeros((8, 8))
        f.ravel()[media.ZIGZAG] = z
        out = np.zeros((8, 8))
        for x in range(8):
            for y in range(8):
                out[y, x] = 128 + sum((math.sqrt(0.5) if u == 0 else 1) * (math.sqrt(0.5) if v == 0 else 1) / 4 * f[v, u] * math.cos((2 * x + 1) * u * math.pi / 16) * math.cos((2 * y + 1) * v * math.pi / 16) for u in range(8) for v in range(8))
        return np.clip(out, 0, 255)

    y = np.block([[samples(c[0]), samples(c[1])], [samples(c[2]), samples(c[3])]])
    cb, cr = (np.kron(samples(c[k]), np.ones((2, 2))) - 128 for k in (4, 5))
    want = np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2), 0, 255)
    assert np.abs(got - want).max() <= 2


def test_zigzag_and_load(spark, docs):
    assert media.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]
    one = rows(media.load(media.store(docs.limit(1)), ("doc_id",)))[0]
    assert len(one["rgb"]) == 3 * one["width"] * one["height"]


def test_long_end_of_band_runs_are_read():
    """A file by hand: one scan of DC, then one end-of-band run over all luma blocks."""
    tables, _ = media.fixed_parts()
    frame = bytes([8, 0, 16, 0, 16, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    ac = media.segment_bytes(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\x20")  # one code, 0: a run of 4 to 7 blocks
    dc_head = media.segment_bytes(0xDA, b"\3\1\0\2\0\3\0\0\0\0")
    ac_head = media.segment_bytes(0xDA, b"\1\1\0\1\x3f\0")
    code, length = media.codes(0)
    bits = "".join(f"{code[0]:0{length[0]}b}" for _ in range(6))
    dc = int(bits.ljust(-(-len(bits) // 8) * 8, "1"), 2).to_bytes(-(-len(bits) // 8), "big")
    file = b"\xff\xd8" + media.segment_bytes(0xC2, frame) + tables + dc_head + dc + ac + ac_head + bytes([0b00011111]) + b"\xff\xd9"
    _, found = media.coefficients([file])
    assert not found[0].any()


# -- language


def test_language_on_held_out_rows(spark):
    df = queries()["op4_language"](spark, "/root/testdata/sf0.01")
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = rows(df)
    assert Counter(r["doc_id"] for r in got) == Counter(list(truth))
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]][0] for r in held]) >= 0.98
    assert not [r for r in got if r["rejected"] and any(c.isalpha() for c in truth[r["doc_id"]][1] or "")]


def test_language_of_odd_rows(odd, empty):
    model = langid.train(odd)
    got = {r["doc_id"]: r for r in rows(langid.identify(odd, model, ("doc_id", "blob")))}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[3]["lang_pred"] == "und"
    assert got[1]["rejected"] and got[1]["score"] == 0 and got[1]["blob"] == "x"
    assert got[9]["lang_pred"] == "en"
    nothing = langid.train(empty)
    assert {r["lang_pred"] for r in rows(langid.identify(odd, nothing, ("doc_id",)))} == {"und"}
    assert rows(langid.identify(empty, model, ("doc_id",))) == []


def test_without_a_row_to_learn_from_nothing_is_lost(docs):
    given = docs.withColumn("doc_id", docs["doc_id"] * 0 + 7)  # an id that is held out
    got = rows(langid.identify(given, langid.train(given), ("text",)))
    assert all(r["lang_pred"] == langid.UNDETERMINED and r["rejected"] == (not any(c.isalpha() for c in r["text"] or "")) for r in got)


@pytest.mark.parametrize("doc_id", ["cast(null AS long)", "cast(44 AS long)"])
def test_language_with_one_id_or_none(spark, docs, doc_id):
    """Ids that repeat or lack are no reason to learn less: all languages are known, and as well as ever."""
    given = docs.withColumn("doc_id", __import__("pyspark.sql.functions", fromlist=["expr"]).expr(doc_id))
    model = langid.train(given)
    assert set(model.languages) == {r[0] for r in docs.select("lang").distinct().collect() if r[0]}
    got = rows(langid.identify(given, model, ("lang",)))
    assert len(got) == docs.count()
    clean = [r for r in got if r["lang"] and r["lang_pred"] != langid.UNDETERMINED]
    assert np.mean([r["lang"] == r["lang_pred"] for r in clean]) > 0.97 and sum(r["rejected"] for r in clean) <= 0.02 * len(clean)


def test_the_sample_is_bounded_and_copies_teach_once(spark, monkeypatch):
    rows_ = [(None, f"some text number {k % 40} of {k % 3}", f"l{k % 3}") for k in range(3000)] + [(k, f"dirty {k}", f"label{k}") for k in range(300)]
    given = spark.createDataFrame(rows_, "doc_id long, text string, lang string").repartition(6)
    assert langid.sample(given, per_language=10).where("lang = 'l1'").count() == 10
    assert langid.sample(given).where("lang in ('l0', 'l1', 'l2')").count() == 120
    monkeypatch.setattr(langid, "MOST_LABELS", 5)
    monkeypatch.setattr(langid, "MOST_ROWS", 20)
    drawn = [tuple(r) for r in langid.sample(given).select("lang", "text").collect()]
    assert len(drawn) <= 20 and {"l0", "l1", "l2"} <= {lang for lang, _ in drawn}
    assert sorted(drawn) == sorted(tuple(r) for r in langid.sample(given.repartition(3)).select("lang", "text").collect())


def test_language_against_plain_code():
    """TF-IDF vectors, cosine with every centroid, and rejection, gram by gram."""
    texts = ["the cat and the hat", "der Hund und die Katze", "el perro y la gata", "The DOG.", "zzz qqq 11"]
    counts, _ = langid.gram_counts(texts)
    model = langid.fit(["en", "de", "es"], counts[:3], centroids=1)

    def grams(text):
        out = Counter()
        codes = [ord(c) if c.isalpha() else 32 for c in f"  {text.lower()}  "]
        for size, salt in ((1, 0x9E3779B1), (2, 0x85EBCA6B), (3, 0xC2B2AE35)):
            for k in range(len(codes) - size + 1):
                part, h = codes[k : k + size], 0
                if any(chr(c).isalpha() for c in part):
                    for c in part:
                        h = (h ^ c) * salt % 2**32
                        h ^= h >> 15
                    out[h * 0x27D4EB2F % 2**32 >> 21] += 1
        return out

    every = [grams(t) for t in texts]
    idf = {g: math.log(4 / (1 + sum(g in x for x in every[:3]))) + 1 for x in every for g in x}

    def vector(x):
        v = {g: math.sqrt(n) * idf[g] for g, n in x.items()}
        length = math.sqrt(sum(w * w for w in v.values()))
        return {g: w / length for g, w in v.items()}

    vectors = [vector(x) for x in every]
    cosine = lambda a, b: sum(w * b.get(g, 0) for g, w in a.items())
    names, scores, rejected = model.predict(texts)
    for k, v in enumerate(vectors):
        near = [cosine(v, c) for c in vectors[:3]]
        best = near.index(max(near))
        assert names[k] == ["en", "de", "es"][best]
        assert scores[k] == pytest.approx(near[best], abs=1e-5)
        assert rejected[k] == (near[best] < langid.MARGIN)


def test_language_depends_on_the_text_alone(odd):
    model = langid.train(odd)
    texts = [t for t in (r["text"] for r in odd.collect())]
    whole = model.predict(texts)
    for k, t in enumerate(texts):
        name, score, _ = model.predict([t])
        assert name[0] == whole[0][k]
        assert score[0] == pytest.approx(whole[1][k], abs=1e-5)


@pytest.mark.parametrize("n,whole", [(0, 64), (1, 64), (63, 64), (64, 64), (65, 128), (128, 128), (129, 192)])
def test_payloads_are_padded_to_a_multiple_of_64(n, whole):
    assert media.padded("x" * n) == b"x" * n + b"\0" * (whole - n)


# -- HTML


def test_main_text_of_all_pages(spark):
    got = {r["page_id"]: r for r in rows(queries()["op5_html"](spark, SF))}
    pages = rows(spark.read.parquet(f"{SF}/pages.parquet"))
    assert len(got) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", p["html"], re.S)[1]
        want = " ".join(entities.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", inner))).split())
        assert got[p["page_id"]]["text"] == want
        assert got[p["page_id"]]["n_chars"] == len(want)


PAGE = """<html><body class="page has-sidebar"><div id="header"><a href=x>Home</a></div><div class="wrap">
<div class="sidebar"><p>Side text here with words</p></div><div class="post-content"><h2>Title</h2><p>First para with
<a href=y>a link</a> and <i>mo</i>re text, long enough to count.</p><p>Second para &amp; more&nbsp;text.<ul><li>one<li>two</ul>
<div class="notice">We use cookies</div><script>if (a<b) {"</p>"}</script></div><div class="comments"><p>I am a reader with a
very long comment that says many things, over and over, again and again and again and again.</p></div></div><form><p>Sign up
</form><div class=footer>foot</div></body></html>"""


@pytest.mark.parametrize(
    "page,text",
    [
        (PAGE, "Title First para with a link and more text, long enough to count. Second para & more text. one two"),
        (None, ""),
        ("", ""),
        ("plain text only", "plain text only"),
        ("<p>a<p>b</div>c", "a b c"),
        ("<article class=comment><p>bad</p></article><article><p>good</p></article>", "good"),
        ("<main><p>x</main><!-- never closed <p>y", "x"),
        ("<nav><p>menu</nav>", ""),
        ("<p title='a>b'>q &lt;p&gt; &#233;&eacute;", "q <p> éé"),
        ("<div><a href=1>one</a> <a href=2>two</a></div><div><p>" + "words and words. " * 20 + "</p></div>", ("words and words. " * 20).strip()),
    ],
)
def test_main_text_of_odd_pages(page, text):
    assert html.main_text(page) == text


def test_main_text_of_sibling_containers():
    """No article element; two containers of the body both reach the threshold, a short one of links doesn't."""
    first, second = ([f"{w} paragraph {k} " + "with many plain words " * 8 for k in range(n)] for w, n in (("First", 4), ("Second", 3)))
    told = ["".join(f"<p>{x}</p>" for x in part) for part in (first, second)]
    page = f"<html><body><div><a href=/a>a</a><a href=/b>b</a></div><div>{told[0]}</div><div>{told[1]}</div></body></html>"
    assert html.main_text(page) == " ".join(x.strip() for x in first + second)


def without(page, article, classes):
    page = re.sub(r"</?article>", "", page) if article == "none" else page.replace("article>", "div>") if article == "div" else page
    return re.sub(r' class="?[^ >]*', "", page) if classes else page


def hand_marked(page):
    inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    return " ".join(entities.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", inner))).split())


@pytest.mark.parametrize("article,classes,least", [("none", False, 1), ("div", False, 1), ("kept", True, 0.97), ("none", True, 0.97), ("div", True, 0.97)])
def test_density_tells_the_article_without_its_element(spark, article, classes, least):
    """Pages without the article element, and without the class that names the advert: what is left is density."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    right = [html.main_text(without(p, article, classes)) == hand_marked(p) for p in pages]
    assert np.mean(right) >= least


def test_density_is_what_decides(spark, monkeypatch):
    """With every density alike, the same pages are no longer told apart."""
    pages = [without(r["html"], "div", True) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    told = [html.main_text(p) for p in pages]
    monkeypatch.setattr(html, "composite_density", lambda *a: 1.0)
    assert np.mean([a == html.main_text(p) for a, p in zip(told, pages, strict=True)]) < 0.5


TEXT = "A sentence with many plain words in it, and then some more of them. " * 4


@pytest.mark.parametrize(
    "page,text",
    [
        # headings named like boilerplate, classes that only hold such a word, and link-only blocks between text
        (f"<body><nav>menu</nav><div><h2 id=related-work>Related work</h2><p>{TEXT}</p><div class=form-factor>Small parts.</div><p><a href=x>a linked paragraph</a></p><p>{TEXT}</p></div></body>", f"Related work {TEXT}Small parts. a linked paragraph {TEXT}"),
        # the heading stands before the container
        (f"<body><div class=ad>Buy</div><h1>Title</h1><div><p>{TEXT}</p><p>{TEXT}</p></div><div class=comments><p>{TEXT}</p></div></body>", f"Title {TEXT}{TEXT}"),
        # comments longer than the article
        (f"<div><h1>Title</h1><p>{TEXT}</p></div><div id=comments><p>{TEXT}{TEXT}</p><p>{TEXT}{TEXT}</p></div>", f"Title {TEXT}"),
        # a list of links at the end of the container
        (f"<div><p>{TEXT}</p><p>{TEXT}</p><ul><li><a href=1>more like this</a></li><li><a href=2>and this</a></li></ul></div>", f"{TEXT}{TEXT}"),
        # sections of one kind, some short
        (f"<div><section><h2>One</h2><p>{TEXT}</p><p>{TEXT}</p></section><section><h2>Two</h2><p>{TEXT}</p></section></div>", f"One {TEXT}{TEXT}Two {TEXT}"),
    ],
)
def test_main_text_by_hand(page, text):
    assert html.main_text(page) == text.strip()


@pytest.mark.parametrize("before,after", [("<form id=aspnetForm>", "</form>"), ("<div role=form>", "</div>"), ("<form><div class=page>", "</div></form>"), ("<aside>", "</aside>"), ("<header>", "</header>")])
def test_a_page_that_stands_in_a_form(before, after):
    text = "Some words of an article that goes on for a while, and then some more. " * 6
    rest = "<nav><a href=/>Home</a></nav><label>Name</label><input><button>Send</button><select><option>One</select>"
    for inner in (f"<article><h1>Title</h1><p>{text}</p></article>", f"<div><h1>Title</h1><p>{text}</p><p>{text}</p></div>"):
        want = html.main_text(f"<body>{inner}</body>")
        assert want.startswith("Title Some words")
        assert html.main_text(f"<body>{before}{rest}{inner}{after}<footer>Foot</footer></body>") == want
    small = "<form action=/signup><p>Give us your address and we will write to you.</p><input></form>"
    assert html.main_text(f"<body>{small}<article><h1>Title</h1><p>{text}</p></article>{small}</body>") == html.main_text(f"<article><h1>Title</h1><p>{text}</p></article>")


def test_a_header_in_an_article_is_its_title():
    text = "Some words of an article that goes on for a while, and then some more. " * 6
    page = f"<body><header><h1>Site</h1><p>Claim of the site</p></header><article><header><h1>Title</h1></header><p>{text}</p></article></body>"
    assert html.main_text(page) == f"Title {text.strip()}"


def test_deep_and_long_pages_take_linear_time():
    deep = "<div>" * 20000 + "<p>text</p>" + "</div>" * 20000
    inline = "<p>" + "<b>" * 20000 + "text" + "<p>more" * 2000
    assert html.main_text(deep) == "text"
    assert html.main_text(inline).startswith("text more")
    assert html.main_text(f"<article><p>{'word ' * 400000}</p></article>").count("word") == 400000


def test_odd_page_rows(spark):
    df = spark.createDataFrame([(1, None, None, 5), (None, "u", "<p>x", 5), (1, None, None, 5)], "page_id long, url string, html string, text int")
    assert Counter((r["page_id"], r["url"], r["text"]) for r in rows(html.extract(df))) == Counter({(1, None, ""): 2, (None, "u", "x"): 1})
    assert rows(html.extract(df.limit(0))) == []
    assert html.main_text("<a<a" * 3000 + ">x") is not None


# -- licences


def test_licences_in_texts():
    mit = licenses.FULL["MIT"].replace("the Software", "the Program")
    found = licenses.find(f"foo bar. {mit} end. More text here. And released under GPL-3.0 too.\nLicensed under CC BY-NC 4.0.")
    assert [(x[2], x[3]) for x in found] == [("MIT", "full"), ("GPL-3.0", "notice"), ("CC-BY-NC-4.0", "notice")]
    assert found[0][5] > 0 and found[1][5] == 0
    assert licenses.find("Licensed under CC BY 4.0.")[0][2] == "CC-BY-4.0"
    assert licenses.find("the licence of the driver was lost, and the copyright of a song is a long story") == []
    long = "word " * 5000 + "released under the MIT License " + "word " * 5000
    assert {x[2] for x in licenses.find(long)} == {"MIT"}


@pytest.mark.parametrize("width", [None, 40, 72])
@pytest.mark.parametrize("name,wording", sorted([*licenses.FULL.items(), *licenses.WHOLE.items()]))
def test_whole_licences_are_found(name, wording, width):
    told = wording if width is None else "\n".join(f" * {x}" for x in textwrap.wrap(wording, width, break_on_hyphens=False, break_long_words=False))
    other = "The cat of the house went to any lake or forest, and this is for the dog. " * 20
    for before, after in (("", ""), (other, "\n" + other)):
        [(start, end, found, kind, _, different)] = licenses.find(before + told + after)
        assert (found, kind, different) == (name, "full", 0)
        assert start == len(before) + told.index(told.strip(" *")[:8]) and end >= len(before) + len(told) - 2


def test_notices_stay_in_their_sentence():
    [found] = licenses.find("So it is.\nReleased under\nthe MIT License.")
    assert found[:4] == (10, 40, "MIT", "notice")


def test_every_notice_is_found_whatever_its_case():
    for opening in licenses.OPENINGS:
        for name, called in licenses.NAMES.items():
            for c in called:
                for text in (f"{opening} {c}", f"{opening} {c}".upper(), f"{opening}\n  {c}".lower()):
                    found = licenses.find(f"This module, from 2020, {text}.\nThe rest follows here.")
                    assert [x[2:4] for x in found] == [(name, "notice")], text
                    assert found[0][:2] == (24, 24 + len(text))


def test_planted_licences_against_brute_force():
    """Random texts of licences and other words: exactly those planted, where they were planted."""
    rng = np.random.default_rng(6)
    filler = "tree house river the of in and with some copies software rights terms use water stone".split()
    every = [(n, "full", t) for n, t in [*licenses.FULL.items(), *licenses.WHOLE.items()]] + [(n, "notice", f"{o} {c}") for o in licenses.OPENINGS[:2] for n, called in licenses.NAMES.items() for c in called]
    for _ in range(40):
        text, want = "Start. ", []
        for k in rng.integers(0, len(every), int(rng.integers(1, 9))).tolist():
            name, kind, wording = every[k]
            text += " ".join(rng.choice(filler, int(rng.choice([0, 5, 80, 600])))) + ". "
            start = len(text)
            text += wording + (" " if wording.endswith(".") else ". ")
            want.append((start, start + len(wording.rstrip("./\" ")), name, kind, 0))
        assert [(a, b, n, k, d) for a, b, n, k, _, d in licenses.find(text)] == want


def test_thousands_of_notices_and_more_templates():
    assert len(licenses.find("SPDX-License-Identifier: MIT\n" * 2000)) == 2000
    mixed = "".join(f"part {k} is released under {licenses.NAMES[n][0]}.\n" for k in range(20) for n in licenses.NAMES)
    assert [x[2] for x in licenses.find(mixed)] == list(licenses.NAMES) * 20
    beer = "As long as you retain this notice you can do whatever you want with this stuff. If we meet some day, and you think this stuff is worth it, you can buy me a beer in return. That is the licence."
    assert [(x[2], x[5]) for x in licenses.find(f"So. {beer} And on.", {"Beerware": beer})] == [("Beerware", 0)]
    assert licenses.find(f"So. {beer} And on.") == []


def test_compression_decides():
    """Without what compression saves, no template is a candidate; and the template that saves most is tried first."""
    known = licenses.Templates()
    block = f"It is so. {licenses.WHOLE['BSD-2-Clause']}"
    own = licenses.words_of(block)
    assert licenses.winner(block, own, known, "full")[0] == "BSD-2-Clause"
    known.known = [(n, k, w, known.plain) for n, k, w, _ in known.known]
    assert licenses.winner(block, own, known, "full") is None


def test_licences_of_documents(given):
    df, docs = given
    got = Counter((r["doc_id"], tuple(x["license"] for x in r["licenses"])) for r in rows(licenses.scan(df)))
    assert got == Counter((d, tuple(x[2] for x in licenses.find(t))) for d, t, _ in docs)
    planted = {"CC BY-NC 4.0": "CC-BY-NC-4.0", "Apache License, Version 2.0": "Apache-2.0", "General Public License, version 3": "GPL-3.0", "Released under the MIT License": "MIT"}
    by = dict(got.keys())
    for d, t, _ in docs:
        for wording, name in planted.items():
            if wording in (t or ""):
                assert name in by[d]


# -- top-k


def brute_topk(vectors, k=20):
    good = [(i, [math.floor(64 * float(x)) for x in e]) for i, e in vectors if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    out = Counter()
    for q, a in good:
        if q % 20 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q and len(b) == len(a))[:k]
            out.update((q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1))
    return out


def test_topk_is_exact(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute_topk([(r["vec_id"], r["embedding"]) for r in vectors.collect()])
    assert Counter(tuple(r.values()) for r in rows(queries()["op9_topk"](spark, SF))) == want
    few = topk.search(vectors, vectors.where("vec_id % 20 = 0"), vectors_at_once=130, queries_at_once=10)
    assert Counter(tuple(r.values()) for r in rows(few)) == want


def test_topk_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    given = [(0, [1.0, 0.0]), (20, [1.0, 1.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (4, None), (5, []), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (9, [1.0]), (40, [1.0]), (11, [-1.0, -0.001])]
    df = spark.createDataFrame([(*g, "x", 1) for g in given], "vec_id long, embedding array<float>, whole string, block int")
    found = topk.search(df, df.where("vec_id % 20 = 0"))
    assert Counter(tuple(r.values()) for r in rows(found)) == brute_topk(given)
    assert rows(topk.search(df.limit(0), df.limit(0))) == []
    twice = topk.search(df, df.where("vec_id = 20").union(df.where("vec_id = 20")))
    own = Counter({x: 2 * n for x, n in brute_topk(given).items() if x[0] == 20})
    assert Counter(tuple(r.values()) for r in rows(twice)) == own


def test_threshold_stops_early_and_right():
    """Components of few large values: queries are final after part of the lists, and a known floor ends them sooner."""
    rng = np.random.default_rng(2)
    vectors = np.floor(64 * rng.standard_normal((4000, 3)) ** 3).astype(np.int64)
    lists = topk.Lists(np.arange(4000), vectors)
    read, sooner = 0, 0
    for q, found, scores, entries, scored in lists.search(np.arange(50), vectors[:50], 20):
        every = vectors @ vectors[q]
        every[q] = -(10**18)
        best = np.lexsort((np.arange(4000), -every))[:20]
        assert lists.ids[found].tolist() == best.tolist()
        assert scores.tolist() == every[best].tolist()
        read += scored
        [(_, rows_, _, fewer, _)] = lists.search(np.array([q]), vectors[q : q + 1], 20, np.array([scores[0]]))
        assert fewer <= entries and (not len(rows_) or rows_[0] == found[0])
        sooner += fewer < entries
    assert read < 50 * 4000 / 4 and sooner


def test_threshold_reads_on_to_the_ends():
    """Scores below zero, fewer vectors than k, and components of zero."""
    vectors = np.array([[0, 0], [-5, 0], [-1, -1], [0, -7]])
    lists = topk.Lists(np.array([4, 3, 2, 1]), vectors)
    for q, found, scores, _, scored in lists.search(np.array([9, 9, 9]), np.array([[1, 1], [0, 0], [0, -2]]), 3):
        every = vectors @ [[1, 1], [0, 0], [0, -2]][q]
        best = sorted(zip(-every, [4, 3, 2, 1], strict=True))[:3]
        assert list(zip(scores, lists.ids[found], strict=True)) == [(-s, i) for s, i in best]


def test_topk_of_huge_components(spark):
    big = float(1 << 50)
    given = [(0, [1.0, 0.0]), (20, [1.0, 1.0]), (3, [big, 1.0]), (4, [-big, 1.0]), (5, [1e300, 0.5]), (60, [1e308, -1e308]), (6, [3.0, 2.0])]
    df = spark.createDataFrame(given, "vec_id long, embedding array<double>")
    least, most = -(1 << 63), (1 << 63) - 1
    whole = {i: [math.floor(64 * v) if abs(v) < 1e300 else 64 * int(v) for v in e] for i, e in given}
    want = Counter()
    for q in (0, 20, 60):
        scores = sorted((-min(most, max(least, sum(x * y for x, y in zip(whole[q], whole[i], strict=True)))), i) for i in whole if i != q)
        want.update((q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1))
    assert Counter(tuple(r.values()) for r in rows(topk.search(df, df.where("vec_id % 20 = 0")))) == want
    assert Counter(tuple(r.values()) for r in rows(topk.search(df, df.where("vec_id % 20 = 0"), vectors_at_once=2))) == want
