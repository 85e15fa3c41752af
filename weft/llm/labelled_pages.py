"""Labelled pages that the block labeller of ``extract`` learns from, put together from labelled parts.

The main text carries the attribute ``data-main``; all other parts are what an extractor must leave out.
``%s`` stands for a sentence, ``%l`` for a paragraph, ``%w`` for a few words; they are filled with words of no
meaning, so that only structure, names, lengths, links and cue words can be learned.
"""

from __future__ import annotations

import random
import re

#: Parts around or inside the main text: the elements they come in, the names these are given, their contents.
#: ``!`` marks elements that tell their part by themselves and need no name.
PARTS = {
    "menu": (["nav!", "div", "ul"], "nav menu navigation topnav mainmenu navbar links tabs", ['<ul><li><a href="/">Home</a></li><li><a href="/a">%w</a></li><li><a href="/b">%w</a></li></ul>', '<a href="/">Home</a> <a href="/a">%w</a> <a href="/b">%w</a>', '<li><a href="/">%w</a></li><li><a href="/c">Contact</a></li>']),
    "header": (["header!", "div"], "header banner masthead topbar branding logo", ['<a href="/">%w</a><p>%w</p>', "<p>%s</p>", '<div><a href="/">%w</a></div><p class="tagline">%w</p>']),
    "footer": (["footer!", "div"], "footer bottom colophon copyright legal", ["<p>&copy; 2024 example.com &middot; %s</p>", "&copy; %w. %s", '<p>Copyright 2023 %w. All rights reserved.</p><p><a href="/t">Terms</a> | <a href="/p">Privacy</a></p>', "<p>%l</p><ul><li><a href='/i'>Imprint</a></li></ul>", "%s", "(c) %w 2020"]),
    "side": (["aside!", "div", "section", "td"], "sidebar side rail related widget recommended popular trending more secondary", ["<h3>Related</h3><ul><li><a href='/1'>%s</a></li><li><a href='/2'>%s</a></li></ul>", "<h4>%w</h4><p>%l</p>", "<p>%s</p><p><a href='/1'>%w</a></p>", "%l", "<p>%l</p><p>%l</p>"]),
    "notice": (["div", "section", "p"], "cookie consent notice alert warning gdpr message popup modal overlay disclaimer infobox", ["<p>We use cookies to improve this site. %s</p><button>Accept</button>", "<p>%s</p>", "%s", "<p>%l</p>", "%l"]),
    "advert": (["div", "aside!", "section", "p"], "ad ads advert advertisement sponsored promo promotion banner adsense sponsor", ["%s", "<p>%l</p>", "<p>%s</p><p>%s</p>", "%l", "<a href='/ad'>%s</a>"]),
    "form": (["form!"], "subscribe newsletter login signup search contact", ["<label>Email</label><p>Sign up for our newsletter. %s</p><button>Subscribe</button>", "<label>Search</label><button>Go</button>", "<p>%l</p><label>%w</label>", "<p>%s</p>"]),
    "comments": (["section", "div", "ol", "ul"], "comments comment replies responses discussion feedback reactions disqus thread commentlist reviews", ["<h2>3 Comments</h2><div class='comment'><p>%w says:</p><p>%l</p></div><div><p>%s</p></div>", "<p>%l</p><p>%l</p>", "<li><p>%l</p></li><li><p>%s</p></li>", "<article><p>%l</p></article><article><p>%s</p></article>", "%l", "<h3>Comments</h3><p>%s</p>", "<div><div>%w</div><div>%l</div></div>"]),
    "share": (["div", "ul"], "share social sharing follow tools meta", ["<a href='/f'>Share</a> <a href='/t'>Tweet</a>", "<li><a href='/f'>%w</a></li><li><a href='/t'>%w</a></li>"]),
    "crumbs": (["div", "nav!"], "breadcrumb breadcrumbs crumbs path", ["<a href='/'>Home</a> &gt; <a href='/x'>%w</a>"]),
}
#: What the main text is made of after its title, and the elements and names of what holds it.
BLOCKS = ["<p data-main>%l</p>"] * 4 + ["<p data-main>%w.</p>", "<p data-main>%w.", "<p data-main>%s</p>", "<p data-main>%s</p>", "<p data-main>%l", "<p data-main><b>%s<br>", "<h2 data-main>%w</h2>", "<h3 data-main>%s</h3>", "<ul data-main><li>%s</li><li>%w</li></ul>", "<ol data-main><li>%w</li><li>%s</li></ol>", "<blockquote data-main><p>%l</p></blockquote>", "<table data-main><tr><th>%w</th><td>%w</td></tr></table>", "<pre data-main>%s</pre>", "<figure data-main><figcaption>%s</figcaption></figure>", "<p data-main>%l <a href='/q'>%w</a> %s</p>", "<p data-main><a href='/r'>%s</a> %l</p>", "<div data-main>%l</div>", "<dl data-main><dt>%w</dt><dd>%s</dd></dl>"]
HOLDERS = ["article!"] * 3 + ["main!", "div", "div", "section", "td"]
HOLDER_NAMES = "content article post entry main story body text articlebody page maincontent"
AROUND = ["div", "div", "section", "form", "main", ""]
AFFIXES = ("{}", "{}", "site-{}", "{}-1", "{}Box", "{}_area", "user-{}", "{} clearfix", "page{}", "{}-section")
#: Words of menus and forms that stories use as well, and how often.
CUE_WORDS, CUE_SHARE = "contact cookies comments search share home related privacy login newsletter reply accept".split(), 0.05
#: Begins main text that no element holds.
MARK = "\x01"
#: What plain pages are made of, and what they come in: nothing that tells a story by tag or name.
PLAIN_BLOCKS = ["<p data-main>%l</p>"] * 4 + ["<p data-main>%s</p>"] * 3 + ["<p data-main>%w.</p>", "<p data-main>%l", "<div data-main>%l</div>", "<ul data-main><li>%s</li><li>%w</li></ul>", "<h2 data-main>%w</h2>", "<h1 data-main>%w</h1>", "<blockquote data-main>%s</blockquote>"]
PLAIN_HOLDERS = ["{}"] * 3 + ["<body>{}</body>"] * 2 + ["<div>{}</div>"] * 2 + ["<div><div>{}</div></div>", "<main>{}</main>", "<article>{}</article>", "<section>{}</section>", "<table><tr><td>{}</td></tr></table>", '<div id="wrapper"><div class="col-8">{}</div></div>', '<div class="container">{}</div>', '<div class="row"><div class="column">{}</div></div>', '<div id="page">{}</div>', "<center>{}</center>"]
#: Share of plain pages, of those without any element, and of those with other parts around.
PLAIN, NO_ELEMENT, WITH_PARTS = 0.4, 0.15, 0.5
WORDS = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()


def words(pick: random.Random, low: int, high: int) -> str:
    return " ".join(pick.choice(CUE_WORDS if pick.random() < CUE_SHARE else WORDS) for _ in range(pick.randint(low, high)))


def sentence(pick: random.Random, low: int, high: int) -> str:
    return words(pick, low, high).capitalize() + pick.choice([".", ".", ".", ".", "!", "?", "", "!!", ". %%%", " ***"])


def filled(page: str, pick: random.Random) -> str:
    kinds = {"%w": lambda: words(pick, 1, 4), "%s": lambda: sentence(pick, 3, 14), "%l": lambda: " ".join(sentence(pick, 6, 18) for _ in range(pick.randint(2, 6)))}
    return re.sub("%[wsl]", lambda m: kinds[m[0]](), page)


def held(pick: random.Random, elements: list[str], names: str, inner: str) -> str:
    """``inner`` in one of the elements, by a name unless the element is enough."""
    tag = pick.choice(elements)
    plain = tag.endswith("!")
    name = pick.choice(AFFIXES).format(pick.choice(names.split()))
    attribute = "" if plain and pick.random() < 0.6 else f' {pick.choice(["class", "class", "id"])}="{name}"'
    tag = tag.rstrip("!")
    return f"<table><tr><td{attribute}>{inner}</td></tr></table>" if tag == "td" else f"<{tag}{attribute}>{inner}</{tag}>"


def part(pick: random.Random, kind: str) -> str:
    elements, names, contents = PARTS[kind]
    return held(pick, elements, names, pick.choice(contents))


def parts(pick: random.Random, kinds: list[str], share: float) -> str:
    return "".join(part(pick, k) for k in kinds if pick.random() < share)


def plain_page(pick: random.Random) -> str:
    """A story in plain elements or none, alone or with other parts before and after."""
    story = MARK + pick.choice(["%l", "%l %l", "%s", "%l<br>%l"]) if pick.random() < NO_ELEMENT else "".join(pick.choice(PLAIN_BLOCKS) for _ in range(pick.randint(1, 6)))
    if story[0] != MARK or pick.random() < 0.5:
        story = pick.choice(PLAIN_HOLDERS).format(story)
    if pick.random() >= WITH_PARTS:
        return filled(story, pick)
    before, after = parts(pick, ["notice", "header", "menu", "advert"], 0.4), parts(pick, ["comments", "side", "advert", "form", "footer"], 0.4)
    return filled(before + story + after, pick)


def labelled_page(pick: random.Random) -> str:
    if pick.random() < PLAIN:
        return plain_page(pick)
    body = [f"<h1 data-main>{pick.choice(['%w', '%s'])}</h1>"] if pick.random() < 0.75 else []
    for _ in range(pick.randint(1, 7)):
        body.append(pick.choice(BLOCKS))
        if pick.random() < 0.15:
            body.append(part(pick, pick.choice(["advert", "notice", "form", "side", "share", "advert"])))
    if pick.random() < 0.25:
        body.append(part(pick, pick.choice(["comments", "share", "form"])))
    story = "".join(body)
    if pick.random() < 0.85:
        story = held(pick, HOLDERS, HOLDER_NAMES, story) if pick.random() < 0.9 else f"<div>{story}</div>"
    before = parts(pick, ["notice", "header", "menu", "crumbs", "advert"], 0.5)
    after = parts(pick, ["share", "comments", "side", "advert", "form", "footer"], 0.5)
    if pick.random() < 0.08:
        before = after = ""
    around = pick.choice(AROUND)
    if around and pick.random() < 0.4:
        return filled(f"{before}<{around}>{story}{after}</{around}>{part(pick, 'footer')}", pick)
    return filled(before + story + after, pick)


def labelled_pages(n: int = 1000, seed: int = 7) -> list[str]:
    pick = random.Random(seed)
    return [labelled_page(pick) for _ in range(n)]
