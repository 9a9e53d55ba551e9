"""Secret scans, page text, fingerprints, toxicity and the pipeline."""

import hashlib
import html
import os
import random
import re
import zlib

import numpy as np
import pytest

from tablescope.llm import html_text, multiset_hash, secrets_crf, toxicity
from tests.llm.conftest import texts

FOLDER = "/root/testdata/sf0.01"


def plain_spans(text):
    found = []
    for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, "assign", m.end()))
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def secret_texts():
    r = random.Random(2)
    rows = texts(3, 60)

    def code(n, letters):
        return "".join(r.choice(letters) for _ in range(n))

    for _ in range(60):
        rows.append(f"{r.choice(rows[:50])} password={code(18, '0123456789abcdef')} mail bob{r.randint(1, 99)}@example.org")
        rows.append(f'éè {r.choice(rows[:50])} token = "{code(40, "0123456789abcdef")}" +1 (743) 555-{r.randint(1000, 9999)}')
        rows.append(f"{r.choice(rows[:50])} AKIA{code(16, 'ABCDEFGHIJ234567')} 227.5.221.{r.randint(1, 250)}")
    rows += ["token: token: abcdefghi", "API_KEY='short'", "Passwd:ſecretsecret", "f" * 32, "f" * 31, "f" * 70_000, None, ""]
    rows += ["0123456789abcdef" * 4] * 3
    return rows


def test_secrets(spark):
    rows = secret_texts()
    docs = spark.createDataFrame([(k, t, "x", 5) for k, t in enumerate(rows)], "doc_id long, text string, spans string, n_hex int")
    got = {r.doc_id: r for r in secrets_crf.secrets(docs).collect()}
    for k, t in enumerate(rows):
        want = plain_spans(t or "")
        base = ",".join(f"{name}:{s}:{e}" for s, _, name, e in want)
        assert got[k].base_sha256 == hashlib.sha256(base.encode()).hexdigest(), t[:200]
        assert [got[k].n_assign, got[k].n_access, got[k].n_hex] == [sum(w[1] == i for w in want) for i in range(3)]
        assert set(filter(None, base.split(","))) <= set(got[k].spans.split(","))
    assert sum(got[k].n_crf > 0 for k in range(60)) <= 2  # hardly a span in plain text
    field = secrets_crf.train(docs)
    unseen = "my key wJalrXUtnFEMI7K7MDENGbPxRfiCY0123ab4 stays and 555-3824 goes"
    raw = np.frombuffer(unseen.encode(), np.uint8)
    (span,) = secrets_crf.crf_spans(field, raw, np.array([0, len(raw)]))[0]
    assert unseen[slice(*span)].startswith("wJalr")
    assert secrets_crf.secrets(docs.limit(0)).collect() == []
    assert [r.spans for r in secrets_crf.secrets(docs.where("doc_id = 0")).collect()] == [""]


def test_viterbi_finds_the_best_path():
    r = np.random.default_rng(4)
    field = secrets_crf.Field(r.normal(size=(50, 3)), r.normal(size=(3, 3)), r.normal(size=3), r.normal(size=3))
    chain = np.repeat(np.arange(6), [1, 2, 5, 1, 4, 6])
    words = secrets_crf.Words(chain, chain, chain, r.integers(0, 50, (len(chain), 2)), chain)
    got = secrets_crf.viterbi(field, words)
    scores = field.weights[words.features].sum(axis=1)
    for c in range(6):
        at = np.flatnonzero(chain == c)

        def total(path):
            steps = sum(field.steps[a, b] for a, b in zip(path, path[1:]))
            return field.begin[path[0]] + field.end[path[-1]] + steps + sum(scores[k, p] for k, p in zip(at, path))

        best = max(np.ndindex(*[3] * len(at)), key=total)
        assert tuple(got[at]) == best


def test_every_word_is_decoded():
    """A text's chain holds all its words, plain ones too, and any of them may be given a label."""
    raw = np.frombuffer("give me some plain words and hunter for a secret of letters\nno".encode(), np.uint8)
    words = secrets_crf.describe(raw, np.array([0, len(raw) - 3, len(raw)]))
    assert words.rows.tolist() == [0] * 12 + [1] and words.chain.tolist() == words.rows.tolist()
    weights = np.zeros((secrets_crf._DIM, 3))
    weights[words.features[6], 1] = 1  # the features of "hunter"
    field = secrets_crf.Field(weights, np.zeros((3, 3)), np.zeros(3), np.zeros(3))
    scores = weights[words.features].sum(axis=1)
    assert (secrets_crf.viterbi(field, words) == scores.argmax(axis=1)).all() and scores[6].argmax() == 1


def test_viterbi_of_long_chains():
    """Chains over many blocks have the score of the best path."""
    r = np.random.default_rng(6)
    field = secrets_crf.Field(r.normal(size=(50, 3)), 3 * r.normal(size=(3, 3)), r.normal(size=3), r.normal(size=3))
    chain = np.repeat(np.arange(7), [1000, 64, 65, 1, 128, 63, 301])
    words = secrets_crf.Words(chain, chain, chain, r.integers(0, 50, (len(chain), 2)), chain)
    got, scores = secrets_crf.viterbi(field, words), field.weights[words.features].sum(axis=1)
    for c in range(7):
        own, path = scores[chain == c], got[chain == c]
        best = field.begin + own[0]
        for score in own[1:]:
            best = (best[:, None] + field.steps).max(axis=0) + score
        total = field.begin[path[0]] + field.end[path[-1]] + own[np.arange(len(own)), path].sum() + field.steps[path[:-1], path[1:]].sum()
        assert total == pytest.approx((best + field.end).max())


def article(page):
    inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(p for p in parts if p)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_pages(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(pages).collect()}
    assert got == {k: (t, len(t)) for k, t in want.items()}


def test_page_rules(spark):
    prose = "The house that was on the hill is the one of which they had told him in the spring, and it was not far from here. " * 3
    page = f"""<html><body><div class="top-nav"><a href=a>Home</a> | <a href=b>News</a></div><script>if (a < b) {{ x = "<p>no</p>" }}</script>
      <div id="cookie-notice">We use the cookies that are on this site and it is fine for all of you.</div><h1>A   title &amp; more</h1>
      <div>{prose}</div><div>Short line</div><p>{prose}<b>bold</b>&nbsp;x &#233;</p><!-- <p>hidden</p> --><form>Name <input name=q></form>
      <aside><p>{prose}</p></aside><section class="comments"><p>{prose}</p></section><footer>{prose}</footer>"""
    once = " ".join(prose.split())
    want = f"A title & more\n{once}\nShort line\n{once} bold x é".replace(f"{once} bold", f"{once} bold")
    assert html_text.main_text(page) == want
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "just words"), (None, "u", "<p class='ad'>buy"), (5, "u", "<script>x"), (6, "u", "<p>a</p>" * 20_000)]
    docs = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(((r.page_id or 0, r.text) for r in html_text.extract(docs).collect()))
    assert [g for g in got if g[0] < 6] == [(0, ""), (1, want), (1, want), (2, ""), (3, ""), (4, "just words"), (5, "")]
    assert html_text.extract(docs.limit(0)).collect() == []


_STORY = "The river had been high for most of the week, and the people who lived near it were used to that. " * 3


@pytest.mark.parametrize(
    "before,after",
    [
        ('<div class="layout has-sidebar"><article>', "</article></div>"),
        ('<div id="page" class="social-enabled"><main>', "</main></div>"),
        ('<div class="search-result-page content"><article>', "</article></div>"),
        ('<div class="search widget">', "</div>"),
        ('<article><section id="discussion">', "</section></article>"),
        ('<article><p>One.</p><section class="legal">', "</section></article>"),
        ('<a name="top"><div>', "</div>"),
        ('<a href="x">Back<div>', "</div>"),
    ],
)
def test_words_of_a_class_do_not_lose_the_article(before, after):
    assert _STORY.strip() in html_text.main_text(f'<body><div class="ad">Buy this now</div>{before}<p>{_STORY}</p>{after}</body>').split("\n")


def test_words_of_a_class_decide_side_matter():
    story = f"<p>{_STORY}</p>"
    want = _STORY.strip()
    comments = '<div id="comments">' + f"<article><p>I liked it. {_STORY}</p></article>" * 3 + "</div>"
    links = '<div class="related"><p>More on this: <a href=a>the river in the spring and what was done about it</a></p></div>'
    assert html_text.main_text(f'<div class="page toolbar"><article>{story}{links}</article>{comments}</div>') == want
    assert html_text.main_text(f"<div>{story}</div>{comments}") == want
    assert html_text.main_text(f"<div class=widget><p>A <b>b</b> c. {_STORY}</p></div>") == f"A b c. {want}"
    assert html_text.main_text(f"<main>{story}{comments}<div class='ad-box'>Buy it, it is the best that there is</div></main>") == want


def test_fingerprints(spark):
    rows = list(enumerate(texts(11, 50)))
    docs = spark.createDataFrame([(k * 3, t, "x", 1) for k, t in rows], "doc_id long, text string, fingerprint string, range int")
    got = {r.doc_id: r for r in multiset_hash.edited_fingerprints(docs).collect()}
    ordered = sorted(((k * 3, t or "") for k, t in rows), reverse=True)
    assert len(got) == len(rows)
    prints = {}
    for k, (i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints.setdefault(tuple(sorted(t.split("\n"))) if t else (), set()).add(r.fingerprint)
        if edited == t:
            assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1
    assert all(len(p) == 1 for p in prints.values())
    assert len({f for p in prints.values() for f in p}) == len(prints)
    assert multiset_hash.edited_fingerprints(docs.limit(0)).collect() == []
    odd = spark.createDataFrame([(None, "a b. c"), (5, "x"), (5, "x"), (4, None)], "doc_id long, text string")
    assert len(multiset_hash.edited_fingerprints(odd).collect()) == 4
    alone = multiset_hash.edited_fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_fingerprints_add_up(spark):
    docs = spark.createDataFrame([(1, "one. two\nthree"), (2, "four, five\nsix"), (3, "six\none. two\nfour, five\nthree")], "doc_id long, text string")
    w = {r.doc_id: r.words for r in multiset_hash.fingerprints(docs).collect()}
    row = spark.createDataFrame([(w[1], w[2], w[3])], "a array<long>, b array<long>, c array<long>")
    r = row.select(multiset_hash.added(row.a, row.b).alias("sum"), multiset_hash.taken(row.c, row.a).alias("rest"), multiset_hash.likeness(row.c, row.c).alias("one")).first()
    assert r.sum == w[3] and r.rest == w[2] and r.one == 1.0


def test_toxicity_learns_gapped_words(spark):
    r = random.Random(8)
    names = ["".join(r.choice("abcdefghijklmnoprstu") for _ in range(r.randint(3, 8))) for _ in range(400)]
    bad = ["blockhead", "numbskull", "dunderpate"]
    rows, labels = [], []
    for k in range(700):
        words = [r.choice(names) for _ in range(r.randint(5, 60))]
        toxic = k % 6 == 0
        if toxic:
            for _ in range(3):
                word = r.choice(bad)
                if r.random() < 0.3:
                    at = r.randrange(1, len(word))
                    word = word[:at] + r.choice("-_.x") + word[at:]
                words.insert(r.randrange(len(words)), word)
        rows.append((k, " ".join(words), "en", 0.5))
        labels.append((k, int(toxic), "x"))
    rows += [(1000, None, "en", 0.1), (1001, "", "en", 0.1), (None, "x", "en", 0.1), (1002, "word " * 40_000, "en", 0.1), (3, rows[3][1], "en", 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    known = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    got = toxicity.toxicity(docs, known).collect()
    assert len(got) == len(rows)
    held = [x for x in got if x.doc_id is not None and x.held_out and x.doc_id < 700]
    assert {x.doc_id for x in held} == {k for k in range(700) if zlib.crc32(str(k).encode()) % 5 == 0}
    right = sum(x.predicted == (x.doc_id % 6 == 0) for x in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got)
    by = {x.doc_id: x.predicted for x in got}
    assert by[1000] == by[1001] == by[1002] == 0
    kept = toxicity.without_toxic(docs, known)
    assert kept.columns == docs.columns
    assert toxicity.toxicity(docs.limit(0), known).collect() == []
    assert {x.score for x in toxicity.toxicity(docs, known.limit(0)).collect()} < {0.0} | {x.score for x in got} | {1 / (1 + np.exp(40))}
    # one flipped class in the held-out part changes no score
    flipped = known.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    assert {(x.doc_id, x.score) for x in toxicity.toxicity(docs, flipped).collect()} == {(x.doc_id, x.score) for x in got}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_pipeline(spark, piece_file):
    import corpus_pipeline
    from tests.llm.test_pairs import deduped, linked_components

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.toxic(spark, docs, folder)
    scores = {r.doc_id for r in toxicity.toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 0").collect()}
    assert {r.doc_id for r in kept.collect()} == scores
    lines = corpus_pipeline.lines(spark, docs, folder)
    assert lines.columns == docs.columns
    want = deduped([(r.doc_id, r.text) for r in docs.collect()])
    before = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: (r.text, r.n_chars) for r in lines.collect()}
    assert got == {k: (t, len(t)) for k, t in want.items() if t.strip() or t == before[k]}
    groups = linked_components([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, folder).collect()} == {k for k, (_, c) in groups.items() if c == k}
    done = corpus_pipeline.run(spark, folder)
    assert done.count() > 100 and done.where("NOT lossless").isEmpty()
