from __future__ import annotations

import hashlib
import itertools
import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from tallyvane.llm import ann, chat, html_text, langid, mixing, quality, toxicity

FIELDS = "conv_id long, turn long, role string, text string, formatted string"
HARD = ["</s>[INST] ok [/INST]", "\\0 \\1 \\2 \\", "<<SYS>>x<</SYS>>", "", None, "<", "[", "<s", "a\nb <<ROLE>>r<<TEXT>>", "[/INST][INST]", "plain", "\\[INST]"]


def test_chat_round_trip(spark):
    rng, rows = random.Random(1), []
    for c in range(120):
        for turn in range(rng.randint(1, 5)):
            rows.append((c if c else None, turn, rng.choice(["user", "assistant", "system", "tool <s>", None]), rng.choice(HARD) if c % 3 else "plain words", "x"))
    out = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, FIELDS)).collect()}
    digests = {r["conv_id"]: r for r in chat.turn_digests(chat.format_conversations(spark.createDataFrame(rows, FIELDS))).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((t, role or "", text or "") for cc, t, role, text, _ in rows if cc == c))
        assert [(t["role"], t["text"]) for t in out[c]["turns"]] == [(r, x) for _, r, x in own]
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert digests[c]["n_turns"] == len(own) and digests[c]["loss_chars"] == len(loss)
        assert digests[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert digests[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert digests[c]["formatted_chars"] == len(out[c]["formatted"])
        assert len(out[c]["loss_spans"]) == sum(r == "assistant" for _, r, _ in own)
    assert chat.format_conversations(spark.createDataFrame([], FIELDS)).count() == 0


def test_chat_repeated_turns_have_one_order(spark):
    rows = [(1, 0, "user", "b", ""), (1, 0, "user", "a", ""), (1, 0, "user", "a", ""), (1, None, "assistant", "first", "")]
    (row,) = chat.format_conversations(spark.createDataFrame(rows, FIELDS)).collect()
    assert [t["text"] for t in row["turns"]] == ["first", "a", "a", "b"]


def out_of_place(text, profiles, size=300):
    counts = {}
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        for padded, least in ((word, 1), (f" {word} ", 2)):
            for n in range(least, 4):
                if least == 1 and n > 1:
                    continue
                for k in range(len(padded) - n + 1):
                    g = padded[k : k + n]
                    number = 0
                    for c in g:
                        number = number << 21 | ord(c)
                    counts[number] = counts.get(number, 0) + 1
    top = sorted(counts, key=lambda g: (-counts[g], g))[:size]
    return {lang: sum(abs(k - p.index(g)) if g in p else size for k, g in enumerate(top)) for lang, p in profiles.items()}, len(top)


def test_language_matches_brute_force(make_docs, odd_rows):
    words = {"en": ["the", "and", "thing", "with", "what"], "de": ["der", "und", "nicht", "über", "schön"], "fr": ["les", "où", "très", "avec", "être"]}
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 40))), lang) for k in range(90) for lang in [["en", "de", "fr"][k % 3]]]
    profiles = langid.learn_profiles(make_docs(rows + odd_rows[:1]))
    got = {r["doc_id"]: r for r in langid.identify_languages(make_docs(rows), profiles).collect()}
    for k, text, lang in rows:
        far, n = out_of_place(text, profiles)
        best = min(sorted(far), key=far.get)
        assert got[k]["lang_pred"] == best and abs(got[k]["score"] - (1 - far[best] / (300 * n))) < 1e-9
    assert sum(got[k]["lang_pred"] == lang for k, _, lang in rows) >= 88
    odd = {(r["doc_id"], r["lang_pred"]) for r in langid.identify_languages(make_docs(odd_rows), profiles).collect()}
    assert {(None, "und"), (1, "und"), (2, "und"), (3, "und"), (8, "und")} <= odd
    assert langid.identify_languages(make_docs([]), profiles).count() == 0
    nothing = langid.learn_profiles(make_docs([]))
    assert {r["lang_pred"] for r in langid.identify_languages(make_docs(rows), nothing).collect()} == {"und"}


def test_html_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var t="<p>no</p>";</script></head><body><header><h1>Site</h1></header>
    <nav><ul><li><a href=/a>Home</a></li></ul></nav><div class="cookie-notice">We use cookies here and there.</div>
    <article><h1>Title &amp; more</h1><p><b>First   paragraph<br>goes on.<p>Second with <a href=x>a link</a> and 1 &lt; 2.</p>
    <div class="ad">Buy this now, it is cheap!</div><form><p>Mail <input></p></form></article>
    <aside><p>Other story that is quite long, with many words in it.</p></aside><section id="comments"><p>I disagree with all of this text, it is bad.</p></section>
    <footer>&copy; site</footer></body></html>"""
    assert html_text.main_text(page) == "Title & more First paragraph goes on. Second with a link and 1 < 2."
    plain = "<body><div id=menu><a href=1>One</a> <a href=2>Two</a></div><div><p>" + "Words of the text. " * 9 + "</p><p>" + "More of the text. " * 9 + "</p></div><div class=footer>c</div></body>"
    assert html_text.main_text(plain) == ("Words of the text. " * 9 + "More of the text. " * 9).strip()
    framed = '<body><div class="page with-sidebar"><article class="post has-menu"><p>The story itself.</p></article><article class="comment"><p>Reader says no.</p></article></div></body>'
    assert html_text.main_text(framed) == "The story itself."
    for odd in (None, "", "   ", "<", "<<<>>>", "</p></div>", "<p", "just text", "<!-- <p>x</p>", "<script>x", "<div>" * 3000 + "deep" + "</div>" * 3000):
        assert isinstance(html_text.main_text(odd), str)
    assert html_text.main_text("just text") == "just text"


def test_html_keeps_sibling_parts():
    part = lambda k: [f"Part {k} sentence {j} goes on with some more words of running text." for j in range(3)]
    inner = lambda k: "".join(f"<p>{p}</p>" for p in part(k))
    expected = " ".join(p for k in range(2) for p in part(k))
    for tag in ("section", "article", "div"):
        page = "<html><body>" + "".join(f"<{tag}>{inner(k)}</{tag}>" for k in range(2)) + "</body></html>"
        assert html_text.main_text(page) == expected
    expected = " ".join(p for k in range(3) for p in part(k))
    nested = f"<body><section>{inner(0)}</section><div><section>{inner(1)}</section><section>{inner(2)}</section></div></body>"
    assert html_text.main_text(nested) == expected


def test_html_reads_tags_as_browsers_do():
    assert html_text.main_text("<p title=don't>First para</p><p>It's second</p><p>third</p>") == "First para It's second third"
    assert html_text.main_text('<body><p>start <a href="unclosed>link</a> more words here</p><p>end</p></body>') == "start link more words here end"
    assert html_text.main_text('<div class="overflow-hidden"><p>shown text here</p></div>') == "shown text here"
    assert html_text.main_text("<p>one</p><p hidden>two</p><p style='display: none'>three</p><p>four</p>") == "one four"


def test_html_keeps_all_of_the_article():
    page = """<article><p>Intro text that is long enough to matter.</p><section id="related-work"><p>Earlier work did this.</p></section>
    <div class="search-results"><p>We searched and found.</p></div><ul><li><a href=1>one</a></li><li><a href=2>two</a></li><li><a href=3>three</a></li></ul>
    <div class="ad-slot">Buy now.</div><div class="comment-list"><p>I disagree.</p></div></article>"""
    assert html_text.main_text(page) == "Intro text that is long enough to matter. Earlier work did this. We searched and found. one two three"


def test_html_drops_nothing_inside_articles():
    long = "<p>" + "Words of a long paragraph of the story. " * 12 + "</p>"
    words = " ".join(("Words of a long paragraph of the story. " * 12).split())
    for tag in ("article", "main"):
        page = lambda inside: html_text.main_text(f"<body><nav><a>Menu</a></nav><{tag}>{inside}</{tag}><footer>End</footer></body>")  # noqa: E731, B023
        assert page(f"<div>{long}{long}</div><div><p>Short closing remark.</p></div>") == f"{words} {words} Short closing remark."
        assert page(f"<div class=lead>A lead line.</div><div>{long}{long}</div>") == f"A lead line. {words} {words}"
        for name in ("id=search", "id=promotion-history", "class=comment-syntax", "class=related", "class='notice'"):
            assert page(f"{long}<section {name}><p>What was found.</p></section>{long}") == f"{words} What was found. {words}", name
        for name in ("class=ad", "class='ads box'", "class=comments", "id=comment-list", "class=comments-section", "id=disqus_thread", "class=sponsored"):
            assert page(f"{long}<div {name}><p>{'Buy this now. ' * 40}</p></div>{long}") == f"{words} {words}", name
    # Without an article, the wrapper of the largest density sum stays whatever its name; other noise goes.
    assert html_text.main_text(f"<body><div class='page-with-sidebar'><div>{long}{long}</div></div><div class=sidebar><p>Side text here.</p></div></body>") == f"{words} {words}"
    assert html_text.main_text(f"<body><div class=notice><p>{'We use cookies here. ' * 3}</p></div><div>{long}</div></body>") == words


def test_html_pruning_keeps_what_it_should():
    """Against a plain reading of the rules, over random pages: which leaves are gone."""
    rng = random.Random(5)
    names = ["", "ad", "comments", "sidebar", "site-notice", "search", "comment-syntax", "story"]

    def grow(depth):
        if depth == 0 or rng.random() < 0.3:
            grow.n += 1
            return ("p", "", f"w{grow.n} " + "text goes on here and there " * rng.randrange(1, 12))
        return (rng.choice(["div", "section", "div", "article"]) if depth < 4 else "div", rng.choice(names), [grow(depth - 1) for _ in range(rng.randrange(1, 4))])

    def show(node):
        tag, name, inside = node
        return f"<{tag}{f' class={name}' if name else ''}>{inside if isinstance(inside, str) else ''.join(map(show, inside))}</{tag}>"

    for _ in range(60):
        grow.n = 0
        tree = ("body", "", [grow(4) for _ in range(3)])
        root = html_text.build(show(tree))
        order = html_text.measure(root)
        best = max(order, key=lambda n: n.total)
        chain = set()
        while best is not None:
            chain.add(best)
            best = best.parent
        articles = [n for n in order if n.tag == "article"]
        want = []

        def read(node, within, gone):
            own = (node.attrs.partition("class=")[2] or "").strip()
            holds = any(a is not node and node in parents(a) for a in articles) if articles else node in chain  # noqa: B023
            if own in ("ad", "comments") and (not holds or not articles):  # noqa: B023
                gone = True
            if own in ("sidebar", "site-notice", "search", "comment-syntax") and not (within or node.tag == "article" or holds):
                gone = True
            within = within or node.tag == "article"
            for k in node.kids:
                if isinstance(k, str):
                    if not gone:
                        want.append(k)  # noqa: B023
                else:
                    read(k, within, gone)

        def parents(node):
            out = set()
            while node is not None:
                out.add(node)
                node = node.parent
            return out

        read(root, False, False)
        html_text.prune_named(root, order)
        assert [k for n in html_text.walk(root) for k in n.kids if isinstance(k, str)] == want


def test_html_time_grows_with_the_page():
    shapes = ['<a href="x ', '<a b=">" ', "<!", "<a ", "<p title='", "<b><i></b>", "<li><b></li>", "<ul><li>", '<a b="']
    halves = [("<div>", "</p>"), ("<b>", "<p>"), ("<p>", "</b>")]
    pages = [lambda n, s=s: s * n for s in shapes] + [lambda n, a=a, b=b: a * n + b * n for a, b in halves]
    for page in pages:
        began = time.perf_counter()
        html_text.main_text(page(40_000))
        assert time.perf_counter() - began < 8, page(2)


def dense(node, root):
    """Characters, tags, link characters, link tags and composite density of a subtree, from its definition."""
    text = lambda n: sum(len(" ".join(k.split())) if isinstance(k, str) else text(k) for k in n.kids)
    tags = lambda n, want: sum((k.tag in want if want else 1) + tags(k, want) for k in n.elements())
    links = lambda n: text(n) if n.tag == "a" else sum(links(k) for k in n.elements())
    c, t, lc, lt = text(node), max(tags(node, ()), 1), links(node), tags(node, {"a"})
    if not c:
        return 0.0
    base = np.log(c / max(c - lc, 1) * lc + links(root) / max(text(root), 1) * c + np.e)
    return c / t * np.log(max(c / max(lc, 1) * t / max(lt, 1), 1) + 1) / np.log(base + 1)


def test_html_selects_by_density_sums():
    rng = random.Random(13)

    def part(depth):
        if depth == 0 or rng.random() < 0.2:
            words = " ".join("word" * rng.randint(1, 2) for _ in range(rng.choice([1, 3, 10, 40])))
            return f"<p>{words}</p>" if rng.random() < 0.7 else f"<p><a href=x>{words}</a></p>"
        return "<div>" + "".join(part(depth - 1) for _ in range(rng.randint(1, 4))) + "</div>"

    for _ in range(150):
        order = html_text.measure(html_text.build("<body>" + "".join(part(3) for _ in range(3)) + "</body>"))
        root, block = order[0], lambda k: k.tag not in html_text.INLINE
        density = {id(n): dense(n, root) for n in order}
        total = {id(n): sum(density[id(k)] for k in n.elements() if block(k)) for n in order}
        assert all(abs(n.density - density[id(n)]) < 1e-9 and abs(n.total - total[id(n)]) < 1e-9 for n in order)
        best = max(order, key=lambda n: total[id(n)])
        path, node = [best], best
        while (node := node.parent) is not None and path[-1].tag != "body":
            path.append(node)
        threshold = min(density[id(n)] for n in path)
        chosen = html_text.select(order)
        inside = {id(n) for c in chosen for n in html_text.walk(c)}
        assert id(best) in inside or total[id(best)] == 0
        for node in order:
            ancestors = {id(n) for n in path}
            if id(node) not in ancestors and block(node) and node.chars and density[id(node)] >= threshold and 2 * node.link_chars < node.chars and total[id(best)] > 0:
                assert id(node) in inside or any(id(n) in inside for n in html_text.walk(node)), "a part at the threshold is lost"


def test_html_query_shape(spark):
    rows = [(1, "u", None, "t", 5), (1, "u", None, "t", 5), (None, None, "<p>x</p>", "t", 5)]
    out = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")).collect()
    assert sorted((r["text"], r["n_chars"]) for r in out) == [("", 0), ("", 0), ("x", 1)]


def character_model(text):
    s = toxicity._sign(toxicity.letters(text))
    counts = np.bincount((s[:-2] * 28 + s[1:-1]) * 28 + s[2:], minlength=28**3).reshape(28, 28, 28) + 0.1
    return np.log(counts / counts.sum(2, keepdims=True))


INSULTS = " ".join(["the idiot was stupid and a loser in the trash with a clown at the house by a moron of scum"] * 20)


def test_viterbi_restores_words():
    restore = toxicity.Restorer(character_model(INSULTS))
    pairs = {
        "1d10t": "idiot", "$tup1d": "stupid", "i d i o t": "idiot", "l.o.s.e.r": "loser", "stuuupid": "stupid", "stuupid": "stupid", "mmoorroonn": "moron", "tr@sh": "trash", "cl0wn": "clown",
        "idi07": "idiot", "s c u m": "scum", "1 d 1 0 t": "idiot", "m_0_r_0_n": "moron", "sc um": "scum", "id-iot": "idiot", "the,1d10t;l0ser": "the,idiot;loser", "the i d i o t": "the idiot", "nothing here": "nothing here", "": "", "a house": "a house",
    }
    assert dict(zip(pairs, restore(list(pairs)))) == pairs
    long = "x" * 30 + "m0r0n" + "y" * 30_000
    assert "moron" in restore([long])[0]
    assert restore(["m0r0n" * 3000]) == ["moron" * 3000]
    assert restore(["line\n1d10t\n", "l0ser"]) == ["line\nidiot\n", "loser"]


def every_reading(span, model):
    """The highest log-probability of each reading of a span, with each option of each unit tried with each other."""
    units = [(m[0], m[1]) for m in toxicity.UNIT.finditer(span)]
    sizes, part, options = [*map(len, toxicity.PARTED.split(span))], 0, []
    letters = [u for u, c in units if c and c.isalpha() and len(u) < 3]
    doubled = max(sum(len(u) == 2 for u in letters) - 1, 0) / max(len(letters), 1)
    for k, (unit, char) in enumerate(units):
        if char is None:
            options.append(toxicity._gap(unit, part, sizes))
            part += 1
        else:
            options.append(toxicity._options(char, len(unit), doubled, k == 0 and char in toxicity.OPENINGS or 0 < k == len(units) - 1 and char in toxicity.ENDINGS))
    best = {}
    for chosen in itertools.product(*options):
        logp, x, y = 0.0, 27, 27
        for k, (reading, cost) in enumerate(chosen):
            logp += 0 if reading == " " and y == 27 and k else cost
            for c in reading:
                z = 27 if c == " " else ord(c) - 97
                if z != 27 or y != 27:
                    logp, x, y = logp + model[x, y, z], y, z
        logp += model[x, y, 27] if y != 27 else 0
        reading = "".join(r for r, _ in chosen)
        best[reading] = max(best.get(reading, -np.inf), logp)
    return best


def test_viterbi_finds_the_best_of_all_readings():
    rng, model = random.Random(7), character_model(INSULTS)
    for _ in range(400):
        span = "".join(rng.choice("aidost1@$0! .-*") * rng.choice([1, 1, 1, 2, 3]) for _ in range(rng.randint(1, 6)))
        found = every_reading(span, model)
        assert abs(found[toxicity.viterbi(span, model.tolist())] - max(found.values())) < 1e-9, span


def test_long_spans_have_the_reading_of_the_whole_lattice(monkeypatch):
    rng, model = random.Random(8), character_model(INSULTS).tolist()
    spans = ["".join(rng.choice("aidostmorn1@$0!.-*") * rng.choice([1, 1, 1, 2, 3]) for _ in range(rng.randint(1, 120))) for _ in range(120)]
    whole = [toxicity.viterbi(s, model) for s in spans]
    for window in (1, 7, 20):
        monkeypatch.setattr(toxicity, "WINDOW", window)
        assert [toxicity.viterbi(s, model) for s in spans] == whole


def test_ordinary_words_stay():
    """With a model of the words themselves, and of words that share their beginnings without the doubled letter."""
    said = INSULTS + " good god goods room rom rooms book books price dollars in is the see three letter little add three " * 40
    restore = toxicity.Restorer(character_model(said))
    for text in ("good!", "room 101 book", "book (see the book)", "three 3 books", "good room", "a letter!", "little add in 2024", "* good *", "price is 100 dollars in 2024"):
        assert re.findall(r"\w+", restore([text])[0]) == re.findall(r"\w+", text), text
    assert restore(["|d|ot"])[0] == "idiot" and restore(["!d10t"])[0] == "idiot"


def test_gate_passes_what_decoding_everything_changes():
    """Words of the model's own text, obfuscated or not: where the likeliest reading of a piece differs, the gate lets it in."""
    rng, model = random.Random(9), character_model(INSULTS)
    restore, rows = toxicity.Restorer(model), model.tolist()
    stands = {v: k for k, vs in reversed(toxicity.LEET.items()) for v in vs}
    lost = 0
    for _ in range(1500):
        word = rng.choice(INSULTS.split())
        kind = rng.randrange(4)
        if kind == 1:
            word = "".join(stands.get(c, c) if rng.random() < 0.4 else c for c in word)
        elif kind == 2:
            word = "".join(c * rng.choice([1, 1, 2, 3]) for c in word)
        elif kind == 3:
            word = rng.choice([".", "-", " "]).join(word)
        lost += any(map(str.isalpha, word)) and toxicity.viterbi(word, rows) != restore([word])[0]
    assert lost == 0


def test_sequences_have_whole_words_of_any_length():
    long = "unbelievablydisgusting"
    same = toxicity.sequences([long])[0].tolist()
    assert len(same) == 1 + toxicity.LONGEST - toxicity.SHORTEST + 1
    found, owner = toxicity.sequences(["a word", "", f"some {long}, {long}s"])
    by = [set(found[owner == k].tolist()) for k in range(3)]
    assert set(same) <= by[2] and not by[1] and len(by[0]) == 4
    assert len(set(toxicity.sequences([long + "x"])[0].tolist()) & set(same)) == len(same) - 1


def test_logistic_fit_reaches_the_minimum():
    rng = np.random.default_rng(3)
    x = (rng.random((80, 6)) < 0.3).astype(float)
    y, n = (rng.random(80) < 0.2 + 0.6 * x[:, 0]).astype(float), rng.integers(1, 5, 80).astype(float)
    rows, features = np.nonzero(x)
    w, base = toxicity.fit_logistic(rows, features, y, n, 6, ridge=0.5, rounds=3000)
    error = n * (1 / (1 + np.exp(-(base + x @ w))) - y)
    assert np.abs(np.append(x.T @ error + 0.5 * w, error.sum())).max() < 1e-6


def toxic_rows(n, seed):
    rng = random.Random(seed)
    common = ["and", "the", "with", "from", "house", "river", "table"]
    rows = []
    for k in range(n):
        words = [rng.choice(common) + rng.choice(["", "ing", "ed"]) for _ in range(rng.randint(5, 30))]
        if (y := k % 5 == 0):
            words.insert(rng.randrange(len(words)), rng.choice(["grumbok", "zortil"]) + rng.choice(["", "s"]))
        rows.append((k, " ".join(words), int(y)))
    return rows


def test_toxicity_learns_and_deobfuscates(spark, make_docs, odd_rows):
    rows = toxic_rows(300, 3)
    labelled = spark.createDataFrame([(t, y) for _, t, y in rows] + [(None, 0), ("", 1)], "text string, toxic int")
    model = toxicity.fit_toxicity(make_docs([(i, t, "en") for i, t, _ in rows]), labelled)
    fresh = toxic_rows(100, 4)
    hidden = [(1000, "from the gr0mbok grumb0k river", "en"), (1001, "z o r t i l the table", "en"), (1002, "the river table", "en")]
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(make_docs([(i, t, "en") for i, t, _ in fresh] + hidden), model).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in fresh)
    assert got[1000] >= 0.5 and got[1001] >= 0.5 and got[1002] < 0.5
    assert all(0 <= r["score"] <= 1 for r in toxicity.score_toxicity(make_docs(odd_rows), model).collect())
    assert toxicity.score_toxicity(make_docs([]), model).count() == 0
    blank = toxicity.fit_toxicity(make_docs([]), labelled.limit(0))
    assert {r["score"] for r in toxicity.score_toxicity(make_docs(odd_rows), blank).collect()} == {0.0}


def test_quality_separates_and_is_calibrated(spark, make_docs, odd_rows):
    rng = random.Random(5)
    good = [" ".join(rng.choice(["river", "house", "walks", "over", "the"]) for _ in range(rng.randint(20, 80))) + "." for _ in range(200)]
    bad = [" ".join(rng.choice(["river", "house"]) + rng.choice(["***", "$$$"]) for _ in range(rng.randint(20, 80))) for _ in range(100)]
    labelled = spark.createDataFrame([(t, 1) for t in good[:150]] + [(t, 0) for t in bad[:75]] + [("", 0), (None, None)], "text string, quality int")
    model = quality.fit_quality(labelled)
    rows = [(k, t, "en") for k, t in enumerate(good[150:] + bad[75:])]
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(make_docs(rows), model).collect()}
    assert all((got[k] >= 0.7) == (k < 50) for k in got)
    assert all(0 <= r["score"] <= 1 for r in quality.score_quality(make_docs(odd_rows), model).collect())
    assert {r["score"] for r in quality.score_quality(make_docs(rows), quality.fit_quality(labelled.limit(0))).collect()} == {0.5}
    assert quality.score_quality(make_docs([]), model).count() == 0


def test_quality_matches_a_dense_fit(spark, make_docs, odd_rows):
    """Scale, Fourier features, ridge weights and calibration, solved here over all rows at once."""
    rng = random.Random(21)
    texts = [" ".join(rng.choice(["river", "House", "walks!", "$$$", "2024", "the"]) for _ in range(rng.randint(1, 60))) for _ in range(300)] + ["", None]
    y = np.array([float(rng.random() < (0.9 if "$" not in (t or "$") else 0.3)) for t in texts])
    model = quality.fit_quality(spark.createDataFrame([(t, int(v)) for t, v in zip(texts, y)] + [("x", None), ("x", 5)], "text string, quality int").repartition(5))
    x = np.stack([*map(quality.statistics, texts)])
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.maximum(x.std(0), 1e-6))
    z = np.clip((x - x.mean(0)) / np.maximum(x.std(0), 1e-6), -6, 6)
    draw = np.random.default_rng(17)
    frequencies = draw.normal(size=(x.shape[1], 192)) / 3.0
    phi = np.hstack([np.cos(z @ frequencies + draw.uniform(0, 2 * np.pi, 192)) * np.sqrt(2 / 192), np.ones((len(x), 1))])
    ridge = 1e-3 * len(x) / 193
    dense = np.linalg.lstsq(np.vstack([phi, np.sqrt(ridge) * np.eye(193)]), np.append(y, np.zeros(193)), rcond=None)[0]
    assert np.allclose(model.raw(x), phi @ dense, atol=1e-6)
    bins = np.floor((np.clip(phi @ dense, -0.5, 1.5) + 0.5) / 2 * 1000).astype(int)
    used, n = np.unique(bins, return_counts=True)
    means = np.array([y[bins == b].mean() for b in used])
    # Isotonic means by their definition: the largest over starts of the least over ends of the mean between.
    mean = lambda i, j: np.average(means[i : j + 1], weights=n[i : j + 1])
    iso = [max(min(mean(i, j) for j in range(k, len(used))) for i in range(k + 1)) for k in range(len(used))]
    assert np.allclose(model.levels, iso, atol=1e-9)
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(make_docs([(k, t, "en") for k, t in enumerate(texts)]), model).collect()}
    want = np.clip(np.interp(model.raw(x), model.edges, iso), 0, 1)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert got[300] == got[301]


def test_pool_adjacent_is_isotonic_least_squares():
    x = np.arange(6.0)
    fit = quality.pool_adjacent(x, np.array([1, 3, 2, 2, 5, 4.0]), np.array([1, 1, 1, 2, 1, 1.0]))
    assert np.allclose(fit, [1, 2.25, 2.25, 2.25, 4.5, 4.5])


def test_substring_index_finds_every_code_in_the_radius():
    rng = np.random.default_rng(8)
    codes = rng.integers(0, 1 << 63, (3000, ann.PARTS), dtype=np.uint64)
    codes[:1000] = codes[0]
    for _ in range(9):
        codes[np.arange(1000), rng.integers(0, ann.PARTS, 1000)] ^= np.uint64(1) << rng.integers(0, 63, 1000).astype(np.uint64)
    index = ann.SubstringIndex(codes)
    for radius in (0, 1, 3, 7, 11, 15, 40, 100, 120, 256):
        want = np.flatnonzero(np.bitwise_count(codes ^ codes[0]).sum(1) <= radius)
        assert (index.within(codes[0], radius) == want).all() and set(want) <= set(index.candidates(codes[0], radius))
    assert len(index.candidates(codes[0], 11)) < 1200 and len(ann.SubstringIndex(codes[:0]).within(codes[0], 5)) == 0


def test_nearest_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(600, 16))
    v[100:160] = v[100]
    rows = [(k, x.tolist(), 0) for k, x in enumerate(v)] + [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [float("nan")] * 16, 0), (2060, [None] * 16, 0), (2080, [1.0], 0), (None, [1.0] * 16, 0)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int"), block=200, group=16).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hits = 0
    for q in range(0, 600, 20):
        score = (v * v[q]).sum(1)
        score[q] = -np.inf
        top = np.lexsort((np.arange(600), -score))[:20]
        assert sorted(got[q]) == list(range(1, 21))
        near = [got[q][k] for k in range(1, 21)]
        assert near == sorted(near, key=lambda x: (-x[1], x[0])) and all(abs(s - score[i]) < 1e-12 for i, s in near)
        hits += len({i for i, _ in near} & set(top.tolist()))
    assert set(got) == set(range(0, 600, 20)) and hits >= 0.9 * 600
    assert [got[100][k][0] for k in range(1, 21)] == list(range(101, 121))
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert ann.nearest(empty).count() == 0
    few = ann.nearest(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>, score int")).collect()
    assert sorted((r["query_id"], r["rank"]) for r in few) == [(0, 1), (0, 2)]


def test_mixing_matches_targets(spark, make_docs, odd_rows):
    rng = random.Random(10)
    plain = lambda: " ".join(rng.choice(["river", "house", "over"]) for _ in range(rng.randint(5, 60)))
    loud = lambda: " ".join(rng.choice(["BUY", "NOW!!", "CHEAP$"]) for _ in range(rng.randint(5, 60)))
    rows = [(k, plain() if k % 3 else loud(), "en") for k in range(1000, 1300)]
    labelled = spark.createDataFrame([(t, "good" if k % 3 else "bad") for k, t, _ in rows[:150]] + [(None, "good")], "text string, domain string")
    out = mixing.mix(make_docs(rows + odd_rows), labelled, {"good": 0.9, "bad": 0.1}).collect()
    assert len(out) == len(rows) + len(odd_rows) and all(r["rate"] >= 0 and abs(sum(r["posteriors"]) - 1) < 1e-9 for r in out)
    total = sum(r["tokens"] for r in out)
    got = [sum(r["rate"] * r["tokens"] * r["posteriors"][k] for r in out) / total for k in (0, 1)]
    assert abs(got[0] - 0.9) < 0.01 and abs(got[1] - 0.1) < 0.01
    assert all(r["tokens"] == 0 for r in out if r["doc_id"] in (1, 2, 3))
    boxed = mixing.mix(make_docs(rows), labelled, {"good": 0.9, "bad": 0.1}, max_rate=1.0)
    assert boxed.agg(F.max("rate")).first()[0] <= 1
    assert mixing.mix(make_docs([]), labelled, {"good": 0.9, "bad": 0.1}).count() == 0
    unknown = mixing.mix(make_docs(rows), labelled.limit(0), {"good": 0.5, "bad": 0.5}).collect()
    assert all(r["posteriors"] == [0.5, 0.5] for r in unknown)
