import itertools
import random

import pytest

from weft.llm import extract
from weft.llm.labelled_pages import labelled_pages

P = "Some words of the story that go on for a while, and then stop here. Another sentence follows with more words."


@pytest.fixture(scope="module")
def field():
    return extract.standard_field()


def test_held_out_pages(field):
    right = total = 0
    for page in labelled_pages(200, seed=1234):
        found = extract.marked(extract.blocks(page, labelled=True))
        right += sum(b.main == d for b, d in zip(found, field.decode(found)))
        total += len(found)
    assert right > 0.97 * total


def test_viterbi_is_the_best_sequence(field):
    pick = random.Random(5)
    for page in labelled_pages(60, seed=pick.random()):
        found = extract.blocks(page)[:9]
        emit = [field.emission(b) for b in found]

        def score(labels):
            return field.begin[labels[0]] + sum(e * y for e, y in zip(emit, labels)) + sum(field.moves[a][b] for a, b in zip(labels, labels[1:]))

        if found:
            best = max(itertools.product((0, 1), repeat=len(found)), key=score)
            assert abs(score([int(x) for x in field.decode(found)]) - score(best)) < 1e-9


def test_text(field):
    page = f"""<!DOCTYPE html><title>T</title><style>p{{}}</style><script>var t="</p>";</script><nav><a href="/x">Home</a></nav>
    <!-- <p>no</p> --><div class="ad">{P}</div><article><h1>A  title&amp;more</h1><p>{P}<p>caf&eacute;\n <b>b</b>o&#108;d<br>x</p><form><p>Sign up</p></form></article>
    <div class="comments"><p>{P}</p></div><footer>&copy; {P}</footer>"""
    assert field.text(page) == f"A title&more {P} café bold x"


def test_odd_markup(field):
    for page in ("", "<", "<p", "</p></div>", "<!--", "<script>", "a < b > c", "<a title='x>y", "<p>" * 3000 + "x", "<div class=\"a" * 500, "&#xfffffff; &bogus;", "\0"):
        assert isinstance(field.text(page), str)
    assert [b.text for b in extract.blocks("<p>a<!-- x -->b<p>c</p>d<table><tr><td>e<td>f</table>")] == ["ab", "c", "d", "e", "f"]


def test_edge_rows(spark, field):
    page = f"<nav>x</nav><article><p>{P}</p></article>"
    rows = [(1, "u", page, "k"), (1, "u", page, "k"), (None, None, page, None), (2, "u", None, "k"), (3, "u", "", "k"), (4, "u", page * 500, "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, `a.b` string")
    out = extract.main_text(df, keep=["url", "a.b"]).collect()
    assert sorted((r.page_id if "page_id" in r else r.doc_id) or 0 for r in out) == [0, 1, 1, 2, 3, 4]
    assert all(r.n_chars == len(r.text) for r in out) and {r.text for r in out if r.doc_id in (2, 3)} == {""}
    assert {r.text for r in out if r.doc_id in (1, None)} == {P}
    assert extract.main_text(df.limit(0)).count() == 0


STORY = [
    "The river rose slowly over the course of three days and nobody in the town seemed to mind.",
    "By the end of the week the lower fields were under water and the cattle had been moved.",
    "An old man said that it had been much worse in the year when he was born near the bridge.",
]
PLAIN = ["{}", "<body>{}</body>", "<html><body>{}</body></html>", "<table><tr><td>{}</td></tr></table>", "<main>{}</main>", "<div>{}</div>", "<section>{}</section>",
         '<div id="wrapper"><div class="col-8">{}</div></div>', '<div class="container">{}</div>', "<article>{}</article>", '<div class="content">{}</div>']


@pytest.mark.parametrize("holder", PLAIN)
def test_plain_pages_are_whole(field, holder):
    inner = "".join(f"<p>{s}</p>" for s in STORY)
    assert field.text(holder.format(inner)) == " ".join(STORY)
    around = f"<nav><a href='/'>Home</a> <a href='/b'>Blog</a></nav>{holder.format(inner)}<footer>&copy; 2020 Example Inc. All rights reserved.</footer>"
    assert field.text(around) == " ".join(STORY)


def test_text_without_elements(field):
    for page in (" ".join(STORY), f"<body>{' '.join(STORY)}</body>"):
        assert field.text(page) == " ".join(STORY)


def test_short_articles_and_cue_words(field):
    assert field.text("<article><p>Yes.</p></article>") == "Yes."
    cues = "Visitors can contact the office about cookies and the newsletter at home."
    assert field.text(f"<article><p>{cues}</p>{''.join(f'<p>{s}</p>' for s in STORY)}</article>") == " ".join([cues, *STORY])


def test_references_end_with_their_run(field):
    assert [b.text for b in extract.blocks("<p>Tom &l<b>t;</b> Jerry &amp<i>;</i> co</p>")] == ["Tom &lt; Jerry &; co"]


def test_given_pages_hold_their_articles(field, spark, sf):
    """The pages of the tables have their story in one article: its blocks, and nothing else."""
    import re

    for row in spark.read.parquet(f"{sf}/pages.parquet").select("html").collect():
        inner = re.findall(r"<article[^>]*>(.*?)</article>", row.html or "", re.S)
        if len(inner) == 1 and "<div" not in inner[0]:
            assert field.text(row.html) == " ".join(b.text for b in extract.blocks(inner[0]))
