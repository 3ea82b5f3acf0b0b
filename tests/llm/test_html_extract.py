import html
import random
import re

from plumbline.llm import html_extract as X
from plumbline.llm import queries

W = X.fit()


def test_articles_of_all_pages(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r["page_id"]: r for r in queries.op1_html_extract(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S).group(1)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|br|h1)[^>]*>", " ", inner))).split())
        assert got[r["page_id"]]["text"] == want
        assert got[r["page_id"]]["n_chars"] == len(want)


def test_boilerplate_of_other_layouts():
    page = """<html><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div id="main-content"><h1>Title here</h1>
    <p>A long first paragraph with &amp; many words that goes on for a while, and says things.</p><div class="ad-box">Buy now! Great value for all of you here.</div>
    <p>Second   paragraph follows the first; it is shorter&nbsp;too.</p><form><label>Name</label><input></form></div>
    <div class="comments"><p>Great article, I really liked reading all this text here.</p></div><aside>Other stories you may like</aside><footer>&copy; 2020</footer>"""
    assert X.extract_text(page, W) == "Title here A long first paragraph with & many words that goes on for a while, and says things. Second paragraph follows the first; it is shorter too."


def test_minimum_cut_against_all_labellings():
    rnd = random.Random(3)
    for _ in range(60):
        n = rnd.randint(1, 8)
        costs = [rnd.randint(-9, 9) for _ in range(n)]
        edges = [{} for _ in range(n)]
        for a in range(n):
            for b in range(a):
                if rnd.random() < 0.5:
                    edges[a][b] = edges[b][a] = rnd.randint(1, 6)

        def price(keep):
            cut = sum(c for a in range(n) for b, c in edges[a].items() if a < b and (a in keep) != (b in keep))
            return cut + sum(c for i, c in enumerate(costs) if c > 0 and i not in keep) + sum(-c for i, c in enumerate(costs) if c < 0 and i in keep)

        best = min(price({i for i in range(n) if m >> i & 1}) for m in range(1 << n))
        assert price(X.content_side(costs, edges)) == best


def test_edges(spark):
    schema = "page_id long, url string, html string, text string"
    rows = [(1, "u", None, "t"), (1, "u", None, "t"), (2, None, "", "t"), (None, "u", "<p>" * 3000, "t"), (4, "u", "<div " * 2000, "t"), (5, "u", "<article><p>Tail without end, but a sentence.", "t"), (6, "u", "<p>" + "word " * 50_000, "t")]
    got = X.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r["n_chars"] for r in got) == sorted([0, 0, 0, 0, 0, len("Tail without end, but a sentence."), 249_999])
    assert X.extract(spark.createDataFrame([], schema)).count() == 0


def test_unclosed_embedded_elements_and_math():
    first, last = "A first paragraph that says enough, and then some more.", "The last paragraph, which is also long enough to be kept."
    for tag in ("noscript", "object", "video", "audio", "canvas", "svg", "select", "select><option>Pick", "math"):
        assert X.extract_text(f"<article><p>{first}</p><{tag}><p>{last}</p></article>", W).endswith(last), tag
    assert X.extract_text(f"<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds. {first}</p></article>", W) == f"So x=2 holds. {first}"
    assert X.extract_text(f"<article><p>{first}</p><select><option>One<option>Two</select><p>{last}</p></article>", W) == f"{first} {last}"


def test_costs_are_learned():
    right = plain = total = 0
    for page, label in X.sample_pages(X.LEXICON, X.NEVER, 150, seed=5):  # other pages than those learned from
        blocks = X.blocks_of(page)
        costs = X.costs_of(blocks, W)
        keep = X.content_side(costs, X.smoothness(blocks))
        right += sum((i in keep) == label[b.text] for i, b in enumerate(blocks))
        plain += sum((c > 0) == label[b.text] for c, b in zip(costs, blocks))
        total += len(blocks)
    assert right >= 0.995 * total and right >= plain


LAYOUTS = {
    "de": ("Startseite Produkte Preise Kontakt", "Der erste Absatz erzählt ausführlich, worum es in dieser Geschichte eigentlich geht.", "Ein zweiter Absatz folgt danach.", "anzeige werbung"),
    "es": ("Inicio Noticias Deportes Cultura", "El primer párrafo cuenta con detalle de qué trata en realidad toda esta historia.", "Después sigue un segundo párrafo.", "publicidad"),
    "tr": ("Anasayfa Haberler Spor İletişim", "İlk paragraf, bu hikâyenin aslında ne hakkında olduğunu uzun uzun anlatıyor.", "Ardından ikinci paragraf gelir.", "reklam"),
}


def test_pages_without_known_names():
    for menu, first, second, advert in LAYOUTS.values():
        links = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in menu.split())
        page = f"<body><div><ul>{links}</ul></div><div class='row'><div class='c8'><h1>{second[:-1]}</h1><p>{first}</p><p>{second}</p></div></div><div><p>© 2024 {menu}</p></div></body>"
        assert X.extract_text(page, W) == f"{second[:-1]} {first} {second}"
        assert X.extract_text(f"<div class='search-results'><h1>{second[:-1]}</h1><p>{first}</p><p>{second}</p></div>", W) == f"{second[:-1]} {first} {second}"
        assert X.extract_text(f"<article><p>{first}</p><div class='{advert}'>{second}</div><p>{first}</p></article>", W) == f"{first} {first}"


def test_edges_can_overrule_a_cost():
    blocks = X.blocks_of("<div><p>One long sentence that is clearly content, with many words.</p><p>2</p><p>Another long sentence that is clearly content, too.</p></div>")
    costs = X.costs_of(blocks, W)
    costs[1] = -1500  # a block that looks like boilerplate between two of content
    assert X.content_side(costs, X.smoothness(blocks)) == {0, 1, 2}
    assert X.extract_text("<article><script>var a = 1;</script foo><p>What follows a script is text again.</p></article>", W) == "What follows a script is text again."
