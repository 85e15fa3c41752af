"""Elements without text of the page, closed or not, and texts of math and xmp."""

import pytest

from weft.llm import extract

P = "Some words of the story that go on for a while, and then stop here. Another sentence follows with more words."


@pytest.mark.parametrize(
    "part",
    [
        "<select><option>A<option>B</select>",
        "<form><select><option>A<option>B</form>",
        "<datalist><option value=x><option value=y></datalist>",
        "<select><optgroup label=x><option>A<option>B<optgroup label=y><option>C</select>",
        "<select><option>A<hr><option>B</option></select>",
        "<div><noscript>x</div>",
        "<p><video src=x>A<p>",
        "<div><audio>A</div>",
        "<div><object data=x><param name=y>A</div>",
        "<noscript><p>A<p>B</noscript>",
        "<video><div>A</div><p>B</video>",
        "<p><video><p>A</p></video></p>",
        "<object><object>A</object>B</object>",
        "<svg><text>A</text></svg>",
        "</select></noscript>",
    ],
)
def test_silent_elements(part):
    page = f"{part}<article>{part}<h1>Title</h1>{part}<p>{P}</p></article>"
    assert [b.text for b in extract.blocks(page)] == ["Title", P]


def test_unclosed_at_the_end():
    assert [b.text for b in extract.blocks(f"<p>{P}</p><noscript>x")] == [P]
    assert [b.text for b in extract.blocks(f"<head><meta charset=x>y<body><p>{P}</p>")] == [P]
    assert [b.text for b in extract.blocks(f"<article><noscript>x<p>{P}</p><p>{P}</p></article>")] == [P, P]


def test_math_and_xmp():
    assert [b.text for b in extract.blocks("<p>so <math><mi>E</mi><mo>=</mo><mi>m</mi></math> holds")] == ["so E=m holds"]
    assert [b.text for b in extract.blocks("<p>a<xmp class=x><p>b &amp;</p></xmp>c")] == ["a", "<p>b &amp;</p>", "c"]
    assert [b.text for b in extract.blocks("<noscript><xmp>a</xmp></noscript><xmp>b")] == ["b"]
    page = f"<article><p>{P}</p><p>{P} <math><mi>E</mi></math></p><xmp>{P}</xmp><p>{P}</p></article>"
    assert extract.standard_field().text(page) == f"{P} {P} E {P} {P}"
