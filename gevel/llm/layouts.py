"""Pages laid out by chance from given texts, with what is their article marked: what the trees for real pages are fitted on.

Real pages carry no labels. Here texts of real pages are laid out anew, with the elements and attributes that sites use for articles and for what surrounds them, or with none that tell, and it is known which is which.
"""

from __future__ import annotations

import html
import random

#: Fixed words of attributes, by what they stand for.
ARTICLE = "article post entry content story body text main single prose page copy richtext markdown document news blog field detail".split()
WRAP = "page wrapper container row col site layout app root grid inner outer block section box group clearfix module region panel".split()
AROUND: dict[str, tuple[tuple[str, ...], list[str]]] = {
    "menu": (("nav", "nav", "ul", "div"), "nav menu navbar navigation breadcrumb breadcrumbs topnav links tabs mainnav pagination pager skip language".split()),
    "header": (("header", "header", "div"), "header masthead banner logo topbar site branding top head".split()),
    "footer": (("footer", "footer", "div"), "footer copyright bottom colophon legal credits foot imprint".split()),
    "side": (("aside", "aside", "div", "section"), "sidebar side widget related popular trending recommended tags archive rail secondary teaser teasers more latest newest".split()),
    "notice": (("div", "section", "aside", "p"), "cookie consent notice gdpr alert warning message popup modal overlay privacy announcement info cookies disclaimer paywall".split()),
    "advert": (("div", "div", "aside", "ins", "section"), "ad ads advert advertisement sponsor sponsored promo promotion adsbygoogle banner commercial adslot partner".split()),
    "form": (("form", "form", "div"), "search login signup subscribe contact form newsletter register subscription".split()),
    "comments": (("section", "div", "ol", "div"), "comments comment reply replies respond discussion disqus thread reader responses feedback".split()),
    "share": (("div", "ul"), "share social follow tools sharing buttons actions toolbar print".split()),
}
PLAIN_WORDS = "c x s item wrap el u n b".split()
#: Words of text that is not taken from pages.
FILL = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()
MENU_WORDS = "Home About Contact News Products Services Blog Login Help Privacy Terms Search More Share Next Previous".split()


class Layouts:
    """Lays out pages. long: texts of paragraphs; short: titles, links and the like."""

    def __init__(self, long: list[str], short: list[str], seed: int = 3) -> None:
        self.r = random.Random(seed)
        self.long, self.short = long, short

    def sentence(self, low: int, high: int) -> str:
        words = self.r.choices(FILL, k=self.r.randint(low, high))
        return " ".join(words).capitalize() + self.r.choice(".....!?")

    def paragraph(self) -> str:
        r = self.r
        if self.long and r.random() < 0.6:
            return r.choice(self.long)
        if r.random() < 0.2:
            return self.sentence(1, 6)
        return " ".join(self.sentence(4, 20) for _ in range(r.randint(1, 7)))

    def phrase(self) -> str:
        r = self.r
        if r.random() < 0.3:
            return r.choice(MENU_WORDS)
        return " ".join((r.choice(self.short) if self.short and r.random() < 0.6 else self.sentence(1, 4)).split()[: r.randint(1, 5)])

    def text(self, s: str) -> str:
        """As HTML, at times with inline elements."""
        words = html.escape(s, quote=False).split()
        for _ in range(len(words) // 40):
            k = self.r.randrange(len(words))
            tag = self.r.choice(("b", "i", "em", "strong", 'a href="/x"', "span", "code"))
            words[k] = f"<{tag}>{words[k]}</{tag.split()[0]}>"
        if len(words) > 1 and self.r.random() < 0.05:
            words[self.r.randrange(len(words))] += "<br>"
        return " ".join(words)

    def attributes(self, words: list[str], telling: float) -> str:
        """Class and id of given words, joined as sites do; or none; or ones that don't tell."""
        r = self.r
        if r.random() > telling:
            return "" if r.random() < 0.6 else f' class="{r.choice(PLAIN_WORDS)}{r.randint(1, 99)}"'
        some = r.sample(words, min(len(words), r.choice((1, 1, 1, 2, 2, 3))))
        if r.random() < 0.3:
            some.insert(r.randrange(len(some) + 1), r.choice(WRAP + ["item", "list", "area", "holder"]))
        joined = r.choice((" ".join, "-".join, "_".join, "".join, lambda w: w[0] + "".join(x.title() for x in w[1:])))(some)
        return f' {r.choice(("class", "class", "class", "id", "role"))}="{joined}"'

    def links(self, n: int) -> str:
        r = self.r
        kind = r.random()
        each = [f'<a href="/{k}">{self.text(self.phrase())}</a>' for k in range(n)]
        if kind < 0.6:
            return "<ul>" + "".join(f"<li>{a}</li>" for a in each) + "</ul>"
        return r.choice((" | ", " ", "<br>", " &middot; ")).join(each) if kind < 0.8 else "".join(f"<div>{a}</div>" for a in each)

    def prose(self, n: int) -> str:
        return "".join(f"<p>{self.text(self.paragraph())}</p>" for _ in range(n))

    def around(self, kind: str, mark: bool = False) -> str:
        """Something that is not the article."""
        r = self.r
        tags, words = AROUND[kind]
        tag = r.choice(tags)
        if kind == "menu":
            inner = self.links(r.randint(2, 12))
        elif kind == "header":
            inner = r.choice((f"<h1>{self.text(self.phrase())}</h1>", f"<a href='/'>{self.text(self.phrase())}</a>", "")) + r.choice(("", self.around("menu"), f"<p>{self.text(self.phrase())}</p>", self.around("form")))
        elif kind == "footer":
            inner = r.choice((f"&copy; {self.text(self.phrase())} &middot; {self.text(self.paragraph())}", f"<p>&copy; {self.text(self.phrase())}</p>" + self.links(r.randint(1, 8)), f"<p>{self.text(self.paragraph())}</p>", self.links(4)))
        elif kind == "side":
            inner = "".join(f"<h3>{self.text(self.phrase())}</h3>{r.choice((self.links(r.randint(2, 8)), self.prose(1), f'<div>{self.text(self.paragraph())}</div>'))}" for _ in range(r.randint(1, 3)))
        elif kind == "notice":
            inner = r.choice((self.prose(1), self.text(self.paragraph()), f"{self.text(self.sentence(5, 25))} <a href='/p'>{self.text(self.phrase())}</a>")) + r.choice(("", "<button>OK</button>", "<a href='#'>OK</a>"))
        elif kind == "advert":
            inner = r.choice((self.text(self.paragraph()), self.text(self.sentence(3, 15)), f"<a href='/ad'>{self.text(self.sentence(3, 12))}</a>", f"<h4>{self.text(self.phrase())}</h4>{self.prose(1)}"))
        elif kind == "form":
            inner = r.choice(("", f"<h3>{self.text(self.phrase())}</h3>", self.prose(1))) + "".join(f"<label>{self.text(self.phrase())}</label> <input name='n{k}'>" for k in range(r.randint(1, 4))) + r.choice(("<button>Go</button>", "<input type='submit'>", f"<textarea></textarea><p>{self.text(self.sentence(3, 12))}</p>"))
        elif kind == "comments":
            one = "li" if tag == "ol" else r.choice(("div", "article", "section"))
            inner = ("" if tag == "ol" else f"<h3>{r.randint(0, 40)} {self.text(self.phrase())}</h3>") + "".join(
                f"<{one}{self.attributes(words, 0.6)}><{(who := r.choice(('b', 'div', 'span', 'cite')))}>{self.text(self.phrase())}</{who}> {r.choice(('', '<time>2020</time>'))}{r.choice((self.prose(r.randint(1, 2)), f'<div>{self.text(self.paragraph())}</div>'))}{r.choice(('', '<a href=#>Reply</a>'))}</{one}>" for _ in range(r.randint(1, 6))
            ) + r.choice(("", self.around("form")))
        else:
            inner = self.links(r.randint(2, 5))
        telling = 0.9 if tag in ("div", "section", "p", "ul", "ol", "ins") else 0.5
        truth = ' data-truth="no"' if mark else ""
        return f"<{tag}{self.attributes(words, telling)}{truth}>{inner}</{tag}>"

    def article(self, telling: float) -> str:
        """The article's own blocks, with something that isn't its own in between at times."""
        r = self.r
        out = [f"<{(h := r.choice(('h1', 'h1', 'h2')))}>{self.text(self.phrase() if r.random() < 0.5 else self.sentence(4, 12))}</{h}>"] if r.random() < 0.85 else []
        style = r.random()
        for _ in range(r.choice((1, 2, 3, 5, 8, 12, 20))):
            kind = r.random()
            if kind < 0.08:
                out.append(f"<h{(k := r.randint(2, 4))}>{self.text(self.phrase())}</h{k}>")
            elif kind < 0.13:
                out.append(f"<{(l := r.choice(('ul', 'ol')))}>" + "".join(f"<li>{self.text(self.sentence(2, 20))}</li>" for _ in range(r.randint(2, 7))) + f"</{l}>")
            elif kind < 0.16:
                out.append(f"<blockquote>{self.prose(1)}</blockquote>")
            elif kind < 0.18:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.text(self.phrase())}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 5))) + "</table>")
            elif kind < 0.2:
                out.append(f"<figure><img src='x'><figcaption>{self.text(self.sentence(3, 12))}</figcaption></figure>")
            elif kind < 0.22:
                out.append(f"<pre>{self.text(self.paragraph())}</pre>")
            elif kind < 0.26:
                out.append(self.around(r.choice(("advert", "share", "side", "form", "notice")), mark=True))
            elif style < 0.75:
                out.append(f"<p>{self.text(self.paragraph())}" + ("</p>" if r.random() < 0.9 else ""))
            elif style < 0.85:
                out.append(f"<div>{self.text(self.paragraph())}</div>")
            else:
                out.append(f"{self.text(self.paragraph())}<br><br>")
        if r.random() < 0.2 and len(out) > 3:
            k = r.randrange(1, len(out))
            out[k:] = [f"<section{self.attributes(ARTICLE, 0.3)}>{''.join(out[k:])}</section>"]
        if r.random() < 0.4:
            out = [f"<{(t := r.choice(('div', 'section')))}{self.attributes(ARTICLE, telling)}>{''.join(out)}</{t}>"]
        return "".join(out)

    def page(self) -> str:
        r = self.r
        telling = r.choice((0.0, 0.5, 0.9))
        tag = r.choice(("article", "article", "main", "div", "div", "div", "section", "td"))
        body = f'<{tag}{self.attributes(ARTICLE, telling)} data-truth="yes">{self.article(telling)}</{tag}>'
        if tag == "td":
            cells = [f'<td>{self.links(r.randint(3, 9))}</td>', body]
            body = f"<table><tr>{''.join(cells if r.random() < 0.5 else cells[::-1])}</tr></table>"
        after = [self.around(k) for k in ("share", "comments", "side", "form", "advert") if r.random() < 0.3]
        side = [self.around("side")] if r.random() < 0.4 else []
        middle = side + [body] if r.random() < 0.4 else [body] + side
        inside = r.random() < 0.5
        middle = middle + (after if inside else [])
        for _ in range(r.choice((0, 0, 1, 1, 2, 3))):
            t = r.choice(("div", "div", "div", "main", "section", "form") if r.random() < 0.3 else ("div",))
            middle = [f"<{t}{self.attributes(WRAP, 0.6)}>{''.join(middle)}</{t}>"]
        top = [self.around(k) for k in ("notice", "header", "menu", "advert", "form") if r.random() < 0.45]
        end = ([] if inside else after) + [self.around(k) for k in ("footer", "notice", "menu") if r.random() < (0.8 if k == "footer" else 0.15)]
        if r.random() < 0.3:
            r.shuffle(top)
        return f"<html><head><title>{self.text(self.phrase())}</title></head><body>{''.join(top + middle + end)}</body></html>"
