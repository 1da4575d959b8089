"""Quality rules, toxicity, mixing, chat and HTML on small cases."""

import random
import zlib
from collections import Counter
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from aircapture.llm import chat, mixing, quality, templates, toxicity
from aircapture.llm.common import table
from aircapture.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, target string"


def documents(spark, rows):
    """(doc_id, text[, source]) with extra columns whose names clash with results."""
    full = [(i, t, "en", (s or ["a"])[0], None if t is None else len(t), "x", "y", "z") for i, t, *s in rows]
    return spark.createDataFrame(full, DOCS)


def plain_measures(text):
    w = (text or "").encode().split()
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, x in enumerate(three) if three.count(x) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (
        len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)), len(covered),
    )


TEXTS = [
    None, "", "  \n\t ", "one", "a b c a b c", "x\ny\nx\n\nx \n", "é ü z #|<", "a b " * 400, "w" * 100_000, "a b c d\x0be\x1ff",
]


def test_measures_equal_plain_counts(spark, sf_dir):
    small = documents(spark, list(enumerate(TEXTS)))
    real = table(spark, sf_dir, "documents").limit(60)
    for df in (small, real):
        texts = {r["doc_id"]: r["text"] for r in df.collect()}
        for r in quality.measures(df).collect():
            got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
            assert got == plain_measures(texts[r["doc_id"]])


def test_rules_cover_a_simple_concept(spark):
    good = [(i, " ".join(f"word{i}x{k}" for k in range(60 + i % 7))) for i in range(200)]
    bad = [(1000 + i, " ".join(f"word{i}x{k}#" for k in range(60 + i % 7))) for i in range(60)]
    docs = documents(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + bad], "doc_id long, quality int, toxic int")
    rules = quality.learn(quality.labelled_sample(docs, labels))
    assert rules and any(c.feature == "symbol_share" for c in rules[0].conditions)
    judged = {r["doc_id"]: r["kept"] for r in quality.judge(docs, rules).collect()}
    assert all(judged[i] == (i < 1000) for i in judged)
    assert quality.learn(quality.labelled_sample(docs, labels.where("quality = 1"))) == []
    empty = quality.judge(docs.limit(0), rules)
    assert empty.count() == 0 and {"base_failed", "kept"} <= set(empty.columns)


def toxic_corpus(n=300):
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        words = [f"w{(i * 37 + k * 11) % 900}" for k in range(30)]
        if bad:
            words[7] = ("scoundrel", "rotter")[i // 5 % 2]
        rows.append((i, " ".join(words[:15]) + ". " + " ".join(words[15:])))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxic_words_are_learned_from_training_rows_only(spark):
    rows, labels = toxic_corpus()
    docs = documents(spark, [*rows, (None, "you scoundrel"), (900, None), (901, ""), (902, "fine " * 20_000), (902, "fine words")])
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, known)
    assert {"scoundrel", "rotter"} == set(model.words)
    held = known.withColumn("toxic", F.when(toxicity.in_training(F.col("doc_id")), F.col("toxic")).otherwise(1 - F.col("toxic")))
    assert toxicity.fit(docs, held) == model
    got = toxicity.score(docs, model)
    assert got.columns.count("score") == 1 and got.count() == len(rows) + 5
    for r in got.collect():
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        if r["doc_id"] is not None and r["doc_id"] < 900:
            assert r["predicted"] == int(r["doc_id"] % 5 == 0)
        elif r["text"] is None or "scoundrel" not in r["text"]:
            assert r["predicted"] == 0
    held_out = {r["doc_id"] for r in docs.where(~toxicity.in_training(F.col("doc_id"))).select("doc_id").collect()} - {None}
    assert held_out == {i for i in [*range(300), 900, 901, 902] if zlib.crc32(str(i).encode()) % 5 == 0}
    assert toxicity.fit(docs, known.limit(0)) == toxicity.Model()
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_grammar_weighs_clauses():
    model = toxicity.Model(words={"idiot": 0.95})
    score = toxicity.Scorer(model).score
    plain, aimed = score("an idiot here"), score("you are an idiot")
    denied, told = score("he is a fool, not an idiot"), score('the paper said idiot')
    assert aimed > plain > told > denied > score("nothing here") == model.rest
    assert score("not here. idiot") == plain  # another clause
    assert score("idiotic") == model.rest and score(None) == model.rest
    assert score("they will kill") > score("will kill time") > model.rest


def test_held_out_toxicity_is_right(spark, sf_dir):
    told = QUERIES["op6_toxicity"](spark, "/root/testdata/sf0.1").where("held_out")
    labels = table(spark, "/root/testdata/sf0.1", "labels")
    right = told.join(labels, "doc_id").agg(F.avg((F.col("toxic") == F.col("predicted")).cast("double"))).first()[0]
    assert right > 0.97


def test_mix_meets_its_targets(spark):
    rows = [(i, "w " * (1 + i * i % 97), f"s{i % 5}") for i in range(600)]
    rows += [(1000 + i, "w " * 30, None) for i in range(20)] + [(2000, None, "empty"), (2001, "", "empty"), (None, "a b", "s1")]
    docs = documents(spark, rows + [(7, "w " * 50, "s2")] * 3)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows) + 3
    sizes = {}
    for r in out:
        sizes[r["source"]] = r["source_size"]
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = dict(zip(order, [5, 2, 1] * 3, strict=False))
    total, capped = sum(sizes.values()), set()
    while True:  # water-filling, source by source
        share = (total - sum(3 * sizes[s] for s in capped)) / sum(w for s, w in weights.items() if s not in capped)
        over = {s for s in weights if s not in capped and share * weights[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for s in order:
        target = 3 * sizes[s] if s in capped else share * weights[s]
        mine = [r for r in out if r["source"] == s]
        assert mine[0]["target"] == pytest.approx(target)
        assert sum(r["taken"] for r in mine) == pytest.approx(target, abs=60)
    again = mixing.mix(docs.repartition(7))
    assert sorted(map(str, again.collect())) == sorted(map(str, out))
    assert mixing.mix(docs.limit(0)).count() == 0
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns and copies.count() == sum(r["copies"] for r in out)


def test_mix_does_not_run_python(spark, sf_dir):
    plans = [
        mixing.mix(table(spark, sf_dir, "documents")),
        quality.judge(table(spark, sf_dir, "documents"), []),
    ]
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_every_participant_is_the_assistant_once(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 3, None, "yes"),
        (2, 0, "system", "alone"), (None, 0, "ann", "x"), (None, None, "bob", "y"), (3, 5, "ann", "same"), (3, 5, "ann", "same"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("mask", F.lit(1))
    got = {(r["conv_id"], r["perspective"]): r for r in chat.rotate(df).orderBy(F.col("stretch").asc_nulls_first()).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann"), (None, "bob"), (3, "ann")}
    ann = got[1, "ann"]
    assert ann["text"] == (
        "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n"
        "<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>user name=unknown\nyes<|im_end|>\n"
    )
    assert [ann["text"][m["start"] : m["end"]] for m in ann["mask"]] == ["hi < |im_end|><|im_end|>"]
    assert got[3, "ann"]["text"].count("same") == 2 and len(got[3, "ann"]["mask"]) == 2
    assert got[None, "bob"]["text"] == "<|im_start|>user name=ann\nx<|im_end|>\n" and got[None, "bob"]["start"] > 0
    (first,) = chat.rotate(df).where("conv_id is null and perspective = 'bob' and stretch is null").collect()
    assert first["text"] == "<|im_start|>assistant\ny<|im_end|>\n" and first["start"] == 0
    assert chat.rotate(df.limit(0)).count() == 0


def test_long_dialogues_come_in_pieces(spark):
    rows = [(1, i // 3, ("ann", "bob")[i % 2], f"t{i:04d}") for i in range(900)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pieces = chat.rotate(df, stretch=64, piece=50).where("perspective = 'ann'").orderBy("stretch", "piece").collect()
    assert len(pieces) > 10 and max(r["n_turns"] for r in pieces) <= 50
    whole = "".join(r["text"] for r in pieces)
    assert all(whole[r["start"] :].startswith(r["text"]) for r in pieces) and whole.count("<|im_start|>") == 900
    learned = "".join(whole[r["start"] + m["start"] : r["start"] + m["end"]] for r in pieces for m in r["mask"])
    assert learned.count("<|im_end|>") == 450


ARTICLE = (
    "<!DOCTYPE html><html><head><title>t</title><script>var a='</p>';</script></head><body class='page'><nav><a href=x>menu {n}</a></nav>"
    "<div class='ad'>buy {n}</div><article><h1>Head {n}</h1><p><b>One &amp; two{n}<br>x<p>three\n four</p><aside>side</aside>"
    "<div id='comments'>bad</div></article><footer>&copy; us</footer></body></html>"
)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))


def test_main_text_of_pages(spark):
    rows = [(i, f"http://a.example/{i}", ARTICLE.replace("{n}", str(i))) for i in range(6)]
    cut = ARTICLE.replace("{n}", "7").split("</article>")[0]
    open_ad = ARTICLE.replace("{n}", "8").replace("buy 8</div>", "buy 8")
    no_article = "<html><body><div class=menu><a>m</a></div><div><p>body text</p></div><form>f</form></body></html>"
    rows += [
        (7, "http://a.example/7", cut), (8, "http://a.example/8", open_ad), (9, None, None), (10, "nowhere", ""),
        (11, "http://b.example/", no_article), (11, "http://b.example/", no_article), (12, "http://c.example", "plain <text"),
        (13, "http://c.example", "x " * 100_000), (None, "http://c.example", "<p>a&lt;b"),
    ]
    got = templates.extract(pages(spark, rows)).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    text = {r["page_id"]: r["text"] for r in got}
    for i in (*range(6), 8):
        assert text[i] == f"Head {i} One & two{i} x three four"
    assert text[7] == "Head 7 One & two7 x three four"
    assert text[9] == "" == text[10] and text[11] == "body text" and text[12] == "plain" and len(text[13]) == 199_999
    assert text[None] == "a<b"
    assert templates.extract(pages(spark, rows).limit(0)).count() == 0


def test_templates_are_classes_of_equal_occurrence(spark):
    rows = [(i, f"http://a.example/{i}", ARTICLE.replace("{n}", str(i))) for i in range(6)]
    df = pages(spark, rows).select(templates.host(F.col("url")).alias("host"), F.col("page_id").alias("page"), "html")
    (found,) = templates.templates(df).collect()
    once = {t["path"] for t in found["template"] if t["once"]}
    assert {"html", "html/body.page/nav", "html/body.page/article", "html/body.page/footer"} <= once
    assert "html/body.page/article/p" not in once


@pytest.mark.parametrize(
    "around",
    [
        "<div class='content with-sidebar'>{}</div>", "<main class='no-sidebar'>{}</main>", "<article class='post ad-free'>{}</article>",
        "<div id='page' class='has-cookie-notice'><article>{}</article></div>", "<div role='form'>{}</div>", "<form>{}</form>",
        *(f"<div><{t}>no</div><div>{{}}</div>" for t in ("template", "svg", "math", "select", "object", "canvas", "noscript")),
        "<svg><g><p>{}</p>", "<noscript>no<article>{}</article>", "<p><svg><path d=''/><text>no</text></svg></p><p>{}</p>",
    ],
)
def test_no_name_or_open_element_takes_the_story(around):
    story = "The whole story of the day."
    page = templates.Page(f"<html><body><nav>n</nav>{around.format(story)}<div class='ad'>buy</div></body></html>")
    assert page.text() == story


def test_copies_of_a_page_take_no_text(spark):
    def page(said):
        return f"<html><body><div class=top>Our house</div><div class=story><p>{said}</p></div></body></html>"

    rows = [(i, "http://a.example/", page("copied story")) for i in range(60)] + [(100 + i, "http://a.example/", page(f"story {i}")) for i in range(4)]
    rows += [(200 + i, "http://b.example/", page("copied story")) for i in range(30)]
    rows += [(300 + i, "http://c.example/", page(f"a story that others copied word by word and again</p><p>seen {i}")) for i in range(30)]
    text = {r["page_id"]: r["text"] for r in templates.extract(pages(spark, rows)).collect()}
    assert {text[i] for i in range(60)} == {"copied story"} and [text[100 + i] for i in range(4)] == [f"story {i}" for i in range(4)]
    assert all("copied story" in text[200 + i] and "copied word by word" in text[300 + i] for i in range(30))


def test_the_template_decides_in_articles_too(spark):
    teasers = "<html><body><div class=story><p>Long story {n} told here</p></div><article class=teaser><a href=x>More {n}</a> to read {n}</article></body></html>"
    constant = "<html><body><article><h1>Head {n}</h1><p>Story {n}.</p><div>All stories of our house</div></article><div>Our address</div></body></html>"
    rows = [(i, "http://a.example/", teasers.replace("{n}", str(i))) for i in range(8)]
    rows += [(10 + i, "http://b.example/", constant.replace("{n}", str(i))) for i in range(8)]
    rows += [(20, "http://b.example/", constant.replace("{n}", "x").split(" of our house")[0])]
    text = {r["page_id"]: r["text"] for r in templates.extract(pages(spark, rows)).collect()}
    for i in range(8):
        assert f"Long story {i} told here" in text[i] and text[10 + i] == f"Head {i} Story {i}."


class PlainTags(HTMLParser):
    """Tags of a well-formed page: path and whether it is the end tag."""

    def __init__(self, html):
        super().__init__()
        self.stack, self.tags = [], []
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        self.stack.append(".".join([tag, *(v for _, v in attrs)]))
        self.tags.append(("/".join(self.stack), False))

    def handle_endtag(self, tag):
        self.tags.append(("/".join(self.stack), True))
        self.stack.pop()


def plain_classes(htmls, support=0.5, always=0.8):
    """Sets of paths with one occurrence vector: the order of each ([] if it has none), and whether it ever crosses another."""
    read = [PlainTags(h).tags for h in dict.fromkeys(htmls)]
    counts = [Counter(p for p, end in r if not end) for r in read]
    by = {}
    for path in {p for c in counts for p in c}:
        by.setdefault(tuple(c[path] for c in counts), set()).add(path)
    by = {v: paths for v, paths in by.items() if sum(map(bool, v)) >= support * len(v)}
    orders, crossing = {v: Counter() for v in by}, set()
    for k, tags in enumerate(read):
        spans = []  # class, places of an instance's tags
        for v, paths in by.items():
            if v[k]:
                at = [i for i, (p, _) in enumerate(tags) if p in paths]
                size = len(at) // v[k]
                each = [at[i : i + size] for i in range(0, len(at), size)]
                period = [tuple(tags[i] for i in e) for e in each]
                orders[v][tuple(p for p, end in period[0] if not end) if len(set(period)) == 1 else ()] += 1
                if len(set(period)) > 1:
                    each = [[i for i in at if tags[i][0] == p][j : j + 2] for p in paths for j in range(0, 2 * v[k], 2)]
                spans += [(v, e) for e in each]
        for v, x in spans:
            for w, y in spans:
                if v != w and any(x[0] < i < x[-1] for i in y) and not (x[0] < y[0] and y[-1] < x[-1]):
                    crossing |= {v, w}
    best = {v: next((o for o, n in orders[v].items() if n >= always * sum(map(bool, v))), ()) for v in by}
    return {frozenset(paths): (list(best[v]), v in crossing) for v, paths in by.items()}


def test_classes_equal_a_plain_deduction(spark):
    rng = random.Random(5)
    rows, hosts = [], {}
    for h in range(12):
        kinds = [f"<div class={c}>{{}}</div>" for c in "klmno"]
        for n in range(9):
            some = [k.format("".join(f"<p>{rng.random()}</p>" for _ in range(rng.choice([1, 2, n])))) for k in kinds if rng.random() < 0.9]
            rows_of = "<table>" + "<tr><td class=q>x</td><td class=r>y</td></tr>" * (n % 4) + "</table>"
            if h % 3 == 0:
                rng.shuffle(some)
            html = f"<html><body>{''.join(some)}{rows_of if h % 2 else ''}</body></html>"
            hosts.setdefault(f"{h}.example", []).append(html)
            rows += [(len(rows), f"http://{h}.example/", html)] * (1 + n % 2)
    df = pages(spark, rows).select(templates.host(F.col("url")).alias("host"), "html")
    found = {r["host"]: r["template"] for r in templates.templates(df).collect()}
    wholly = 0
    for h, htmls in hosts.items():
        classes = {}
        for t in found[h]:
            if t["path"]:
                classes.setdefault(t["class"], []).append((t["place"], t["path"]))
        plain = plain_classes(htmls)
        assert {frozenset(p for _, p in c) for c in classes.values()} == set(plain)
        for c in classes.values():
            order, crosses = plain[frozenset(p for _, p in c)]
            if order and not crosses:
                assert sorted(c) == list(enumerate(order))
                wholly += len(c) > 1
            elif not order:
                assert len(c) > 1 and any(k < 0 for k, _ in c)
    assert wholly > 12


def test_elements_that_break_the_order_leave_the_class():
    a, b, c = "abc"

    def order(text):
        return [(t, end) for t in text for end in (False, True)]

    assert templates.ordered_members([(order("abc"), 8), (order("bac"), 2)], 10, 0.8) == [a, b, c]
    kept = templates.ordered_members([(order("abc"), 6), (order("cab"), 4)], 10, 0.8)
    assert kept == [a, b]
    assert templates.ordered_members([([], 10)], 10, 0.8) == []


def test_gaps_lie_between_members_of_ordered_and_nested_classes():
    # x opens twice and holds y each time; z has their vector, too, but breaks the order
    events = [(1, "html"), (2, "x"), (3, "y"), (3, None), (2, None), (2, "x"), (3, "y"), (3, None), (1, None)]
    gaps, orders = templates.instances(events, {"html": 0, "x": 1, "y": 1})
    assert orders == {0: (("html", False), ("html", True)), 1: (("x", False), ("y", False), ("y", True), ("x", True))}
    start = ("html", False)
    assert gaps == [(("y", False), start), (("y", True), start), (("y", False), start), (start, None)]
    gaps, orders = templates.instances([*events, (2, "z"), (2, "z")], {"html": 0, "x": 1, "y": 1, "z": 1})
    assert orders[1] == () and gaps[1] == (("x", False), start)
    # b's second member comes when the instance of a around its first has gone on
    crossing = [(1, "a"), (1, "b"), (1, "c"), (1, "d")]
    _, orders = templates.instances(crossing, {"a": 0, "c": 0, "b": 1, "d": 1})
    assert orders[0] and orders[1] == ()


def test_a_common_body_stays_where_only_headings_vary(spark):
    page = (
        "<html><body><div class=top>Our house of news</div><article><h1>In memory of {n}</h1><p>Died at home, as the family says.</p></article>"
        "<div class=story><p>Long told story {n} of the town and all its people</p></div></body></html>"
    )
    rows = [(i, "http://a.example/", page.replace("{n}", str(i))) for i in range(9)]
    text = {r["page_id"]: r["text"] for r in templates.extract(pages(spark, rows)).collect()}
    for i in range(9):
        assert text[i] == f"In memory of {i} Died at home, as the family says. Long told story {i} of the town and all its people"


def test_the_gap_of_a_class_tells_constant_texts_from_a_story(spark):
    page = (
        "<html><body><h1>Head {n}</h1>{story}<div class=mid>Read by {n} people</div><p>All rights are ours</p></body></html>"
    )
    rows = []
    for i in range(9):
        story = "".join(f"<p>Part {k} of story {i} is here</p>" for k in range(2 + i % 3)) + "<p>All rights are ours</p>"
        rows.append((i, "http://a.example/", page.replace("{n}", str(i)).replace("{story}", story)))
    df = pages(spark, rows)
    text = {r["page_id"]: r["text"] for r in templates.extract(df).collect()}
    for i in range(9):  # said among the paragraphs it is the story's, after the last member it is the template's
        parts = " ".join(f"Part {k} of story {i} is here" for k in range(2 + i % 3))
        assert text[i] == f"Head {i} {parts} All rights are ours Read by {i} people"
    (found,) = templates.templates(df.select(F.lit("a.example").alias("host"), "html")).collect()
    slots = {s["slot"]: s.asDict() for s in found["slots"]}
    for by, same in ((lambda t: t["class"], True), (lambda t: 0, False)):
        elements = {tuple(t["path"].split("/")): {**t.asDict(), "class": by(t)} for t in found["template"] if t["path"]}
        assert (templates.Page(rows[0][2]).text(elements, slots) == text[0]) == same


def test_constants_are_dropped_in_whatever_order_their_elements_come(spark):
    rows = []
    for i in range(10):
        two = ["<div class=k>Our house</div>", "<div class=l>Our town</div>"]
        rows.append((i, "http://a.example/", f"<html><body>{''.join(two[:: 1 - 2 * (i % 2)])}<div class=story><p>A long story {i} told</p></div></body></html>"))
    assert [r["text"] for r in templates.extract(pages(spark, rows)).orderBy("page_id").collect()] == [f"A long story {i} told" for i in range(10)]


def test_long_menus_do_not_make_pages_copies(spark):
    menu = "".join(f"<li><a href=x>Menu entry number {k}</a></li>" for k in range(20))
    page = f"<html><body><nav><ul>{menu}</ul></nav><div class=top>Our house</div><div class=story><p>Short story {{n}}</p></div></body></html>"
    rows = [(i, "http://a.example/", page.replace("{n}", str(i))) for i in range(9)]
    assert [r["text"] for r in templates.extract(pages(spark, rows)).orderBy("page_id").collect()] == [f"Short story {i}" for i in range(9)]
