"""Invented pages with known main text, the training set of the HTML extraction.

A page is assembled from parts in random order and nesting; every element carries
whether it is kept (it holds main text) or dropped. Words are made of random
syllables, the same for both kinds, so that only structure can tell them apart.
"""

from __future__ import annotations

import random
import re

#: Names that sites commonly give to parts of a page.
CONTENT_NAMES = "content article-body post-content entry-content story article post main-content body-text text page-content entry blog-post news-article article__content storytext".split()
NOISE_NAMES = {
    "nav": "nav menu navbar main-menu breadcrumb breadcrumbs navigation top-nav site-nav pagination".split(),
    "header": "header site-header masthead topbar banner page-header logo branding".split(),
    "footer": "footer site-footer colophon copyright legal bottom footer-links credits".split(),
    "sidebar": "sidebar side-bar widget widget-area rail right-column secondary related related-posts recommended most-read trending".split(),
    "ad": "ad ads advert advertisement sponsored promo ad-slot banner-ad adsense sponsor".split(),
    "notice": "cookie cookie-notice cookie-banner consent gdpr notice alert message popup modal newsletter-popup site-notice announcement".split(),
    "form": "newsletter subscribe search login signup contact-form subscription search-form".split(),
    "comments": "comments comment-list comment-section discussion responses reader-comments replies disqus user-comments reactions".split(),
    "share": "share social share-buttons social-links toolbar sharing".split(),
}
ROLES = {"nav": "navigation", "header": "banner", "footer": "contentinfo", "sidebar": "complementary", "notice": "alert", "form": "search"}
_SYLLABLES = "ba co di fu ge ha in jo ku le mi no or pa qui re sa ti un ver wa xe yo zi en der st che ou ll".split()


class _Maker:
    def __init__(self, seed: int, meaningless: bool = False):
        self.r = random.Random(seed)
        self.kept: list[bool] = []
        self.meaningless, self.renamed = meaningless, {}

    def attributes(self, text: str) -> str:
        """Attributes as they are, or with each name replaced by a meaningless one, the same for the whole page."""
        if not self.meaningless or not text:
            return text

        def other(m: re.Match) -> str:
            made = [self.renamed.setdefault(n, "".join(self.r.choices("abcdefghijklmnopqrstuvwxyz", k=self.r.randint(2, 8))) + self.r.choice(["", "-" + self.r.choice("abcdefgh"), str(self.r.randint(0, 99))])) for n in m[2].split()]
            return f'{m[1]}="{" ".join(made)}"'

        return re.sub(' role="[^"]*"', "", re.sub(r'(class|id)="([^"]*)"', other, text))

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = ["".join(r.choices(_SYLLABLES, k=k)) for k in r.choices((1, 2, 3, 4), k=r.randint(low, high))]
        text = " ".join(map("".join, zip(out, r.choices(("", ",", ". "), (12, 1, 1), k=len(out)), strict=True)))
        return text[:1].upper() + text[1:] + r.choice([".", ".", "", "!"])

    def el(self, tag: str, kept: bool, inner, attributes: str = "") -> str:
        """A block element; `inner` is text or a function that makes the children."""
        self.kept.append(kept)
        body = inner() if callable(inner) else inner
        return f"<{tag}{self.attributes(attributes)}>{body}</{tag}>"

    def named(self, names: list[str], sure: float = 0.9) -> str:
        r = self.r
        if r.random() > sure:
            return ""
        name = r.choice(names)
        return r.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {r.choice(["box", "clearfix", "col", "wide", "inner"])}"'])

    def link(self) -> str:
        return f'<a href="/x">{self.words(1, 4)}</a>'

    def links(self, kept: bool = False) -> str:
        r = self.r
        return self.el("ul", kept, lambda: "".join(self.el("li", kept, self.link()) for _ in range(r.randint(2, 9))))

    def paragraph(self, kept: bool, low: int = 3, high: int = 90) -> str:
        text = self.words(low, high)
        odd = self.r.random() if kept else 1
        if odd < 0.04:  # degenerate prose is still the article
            text = " ".join([self.words(1, 1)] * self.r.randint(5, 300))
        elif odd < 0.08:
            text = text.replace(" ", self.r.choice(["$$$ ", "*** ", " | ", "!! ", "&amp;&amp; "]))
        elif odd < 0.1:
            text = self.words(200, 1500)
        if self.r.random() < 0.15:
            text += " " + self.link() + " " + self.words(1, 10)
        if self.r.random() < 0.1:
            text = f"<b>{text}</b>"
        return self.el("p", kept, text)

    def noise(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            tag = r.choice(["nav", "nav", "div", "ul"])
            if tag == "ul":
                return self.links().replace("<ul>", f"<ul{self.attributes(self.named(NOISE_NAMES[kind]))}>", 1)
            return self.el(tag, False, lambda: r.choice([self.links, lambda: " ".join(self.link() for _ in range(r.randint(3, 9)))])(), self.named(NOISE_NAMES[kind], 0.4 if tag == "nav" else 1))
        if kind == "header":
            tag = r.choice(["header", "div"])
            inner = [lambda: self.el(r.choice(["h1", "p", "div"]), False, self.words(1, 5)), self.links, lambda: self.words(1, 6), lambda: self.noise("nav")]
            return self.el(tag, False, lambda: "".join(f() for f in r.sample(inner, r.randint(1, 3))), self.named(NOISE_NAMES[kind], 0.5 if tag == "header" else 1))
        if kind == "footer":
            tag = r.choice(["footer", "footer", "div"])
            inner = [lambda: self.words(2, 20), self.links, lambda: self.el("p", False, "&copy; " + self.words(3, 20))]
            return self.el(tag, False, lambda: "".join(f() for f in r.sample(inner, r.randint(1, 3))), self.named(NOISE_NAMES[kind], 0.4 if tag == "footer" else 1))
        if kind == "sidebar":
            tag = r.choice(["aside", "div", "section"])
            inner = [self.links, lambda: self.paragraph(False, 3, 40), lambda: self.el("div", False, lambda: self.el("h3", False, self.words(1, 4)) + self.links())]
            return self.el(tag, False, lambda: self.el("h3", False, self.words(1, 4)) + "".join(r.choice(inner)() for _ in range(r.randint(1, 3))), self.named(NOISE_NAMES[kind], 0.5 if tag == "aside" else 1))
        if kind == "ad":
            tag = r.choice(["div", "div", "aside", "section", "p"])
            plain = [lambda: self.words(2, 40), lambda: f'<a href="/ad">{self.words(2, 20)}</a>']
            nested = [lambda: self.el("p", False, self.words(3, 40)), lambda: self.el("div", False, self.words(3, 20))]
            return self.el(tag, False, lambda: r.choice(plain if tag == "p" else plain + nested)(), self.named(NOISE_NAMES[kind], 1))
        if kind == "notice":
            tag = r.choice(["div", "div", "section", "aside", "p"])
            text = [lambda: self.words(4, 40)] if tag == "p" else [lambda: self.words(4, 40), lambda: self.paragraph(False, 4, 40), lambda: self.words(4, 30) + self.link()]
            role = ' role="alert"' if r.random() < 0.3 else ""
            return self.el(tag, False, lambda: r.choice(text)(), self.named(NOISE_NAMES[kind], 0.4 if role else 1) + role)
        if kind == "form":
            field = lambda: r.choice(["<input>", '<input type="text">']) + self.words(1, 4)
            inner = [lambda: field() + field(), lambda: self.el("p", False, self.words(2, 25)) + field(), lambda: self.el("div", False, "<label>" + self.words(1, 4) + "</label><input>"), lambda: self.words(2, 20) + "<input>"]
            form = lambda: self.el("form", False, lambda: r.choice(inner)(), self.named(NOISE_NAMES[kind], 0.4))
            return form() if r.random() < 0.6 else self.el(r.choice(["div", "section"]), False, lambda: self.el("h3", False, self.words(1, 5)) + form(), self.named(NOISE_NAMES[kind], 0.8))
        if kind == "comments":
            tag = r.choice(["div", "section", "ol", "ul", "aside"])
            item = "li" if tag in ("ol", "ul") else r.choice(["div", "article", "p"])
            name = r.choice(["comment", "reply", "response", "comment-body"])

            marked, signed, plain = r.random() < 0.7, r.random() < 0.6, r.random() < 0.3
            if self.meaningless and item != "li":  # without names, bare paragraphs could be an article's
                item, signed = "div" if item == "p" else item, True
            signature = r.choice(["div", "p", "header", "h4"])

            def sign() -> str:
                date = r.choice([f"{r.randint(1, 28)}.{r.randint(1, 12)}.20{r.randint(10, 25)}", f"{r.randint(1, 59)} min", f"20{r.randint(10, 25)}-0{r.randint(1, 9)}-1{r.randint(0, 9)} 1{r.randint(0, 9)}:3{r.randint(0, 9)}"])
                who = r.choice(["<b>{}</b>", "{}", '<a href="/u">{}</a>']).format(self.words(1, 2).strip(".!"))
                return r.choice([f"{who} {date}", f"{date} - {who}", who])

            def one() -> str:
                mark = f' class="{name}"' if marked else ""
                text = lambda: "".join(self.paragraph(False, 3, 70) for _ in range(r.choice([1, 1, 1, 2])))
                body = (lambda: self.words(3, 70)) if item == "p" or plain else text
                if signed and item != "p":
                    return self.el(item, False, lambda: self.el(signature, False, sign()) + text() + (self.el("div", False, '<a href="#">' + self.words(1, 1) + "</a>") if plain else ""), mark)
                return self.el(item, False, body, mark)

            head = (lambda: self.el(r.choice(["h2", "h3"]), False, self.words(1, 4))) if item != "li" else (lambda: "")
            return self.el(tag, False, lambda: head() + "".join(one() for _ in range(r.randint(1, 6))), self.named(NOISE_NAMES[kind], 1))
        inner = [self.links, lambda: " ".join(self.link() for _ in range(r.randint(1, 5))), lambda: self.words(1, 4) + ": " + self.link()]
        return self.el("div", False, lambda: r.choice(inner)(), self.named(NOISE_NAMES["share"], 1))

    def main_parts(self) -> str:
        r = self.r
        out = []
        brief = r.random() < 0.15
        if r.random() < 0.85:
            out.append(lambda: self.el(r.choice(["h1", "h1", "h2"]), True, self.words(1, 3) if brief else self.words(2, 12)))
        for _ in range(r.choice([1, 1, 2]) if brief else r.choice([1, 1, 2, 3, 4, 5, 8, 12, 20])):
            out.append(lambda: self.paragraph(True, 1, 10) if brief else self.paragraph(True))
            x = r.random()
            if x < 0.08:
                out.append(lambda: self.el(r.choice(["h2", "h3"]), True, self.words(1, 8)))
            elif x < 0.13:
                out.append(lambda: self.el("ul", True, lambda: "".join(self.el("li", True, self.words(2, 25)) for _ in range(r.randint(2, 5)))))
            elif x < 0.17:
                out.append(lambda: self.el("blockquote", True, r.choice([lambda: self.words(5, 40), lambda: self.paragraph(True, 5, 40)])))
            elif x < 0.19:
                out.append(lambda: self.el("pre", True, self.words(5, 30)))
            elif x < 0.21:
                out.append(lambda: self.el("table", True, lambda: "".join(self.el("tr", True, lambda: "".join(self.el("td", True, self.words(1, 5)) for _ in range(2))) for _ in range(3))))
            elif x < 0.27:
                out.append(lambda: self.noise(r.choice(["ad", "share", "form", "sidebar", "notice"])))
        if r.random() < 0.2:
            out.append(lambda: self.noise(r.choice(["share", "comments", "sidebar", "form"])))
        if r.random() < 0.1:
            return self.el("header", True, out[0]) + "".join(f() for f in out[1:]) if len(out) > 1 and r.random() < 0.5 else self.el("div", True, lambda: "".join(f() for f in out))
        return "".join(f() for f in out)

    def core(self) -> str:
        r = self.r
        x = r.random()
        if x < 0.1:  # no container at all
            return self.main_parts()
        if x < 0.5:
            return self.el("article", True, self.main_parts, self.named(CONTENT_NAMES, 0.4))
        if x < 0.6:
            return self.el("main", True, self.main_parts, self.named(CONTENT_NAMES, 0.3))
        if x < 0.92:
            return self.el(r.choice(["div", "div", "section"]), True, self.main_parts, self.named(CONTENT_NAMES, 0.9))
        return self.el("td", True, self.main_parts) if r.random() < 0.2 else self.el("div", True, self.main_parts)

    def page(self) -> str:
        r = self.r
        self.kept.append(True)  # the root
        top = [k for k in ("header", "nav", "ad", "notice", "form") if r.random() < (0.5 if k != "form" else 0.2)]
        end = [k for k in ("sidebar", "comments", "ad", "share", "notice", "form", "footer") if r.random() < (0.4 if k != "footer" else 0.85)]
        r.shuffle(top)
        if r.random() < 0.3 and end:
            top.append(end.pop(0))

        wrapped = self.core
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            wrapped = lambda f=wrapped: self.el(r.choice(["div", "main", "section"]), True, f, r.choice(["", ' class="wrapper"', ' class="container"', ' id="page"', ' class="row"']))
        if r.random() < 0.25:
            return "".join(map(self.noise, top)) + self.el("div", True, lambda: wrapped() + "".join(map(self.noise, end[:2])), r.choice(["", ' class="layout"', ' id="container"'])) + "".join(map(self.noise, end[2:]))
        return "".join(map(self.noise, top)) + wrapped() + "".join(map(self.noise, end))

    def run(self, kept: bool, brief: bool = False) -> str:
        """Text right in the body: lines of an article, or links, copyright and labels."""
        r = self.r
        self.kept.append(kept)
        if kept:
            lines = []
            for _ in range(1 if brief else r.choice([1, 1, 2, 3, 5, 8])):
                lines.append(self.words(2, 12) if brief else self.words(6, 90))
                if r.random() < 0.15:
                    lines[-1] += " " + self.link() + " " + self.words(1, 10)
            return r.choice(["<br>", "<br><br>", "<br/>\n"]).join(lines)
        x = r.random()
        if x < 0.5:
            return r.choice([" | ", " ", " - ", "<br>"]).join(self.link() for _ in range(r.randint(1, 9)))
        if x < 0.7:
            return "&copy; " + self.words(1, 15)
        return self.words(1, 6) + (": " + self.link() if x < 0.85 else "")

    def loose_parts(self) -> list[tuple[bool, object]]:
        """An article written into the body: whether a part is a run, and the part."""
        r = self.r
        brief = r.random() < 0.15
        out = [(False, lambda: self.el(r.choice(["h1", "h1", "h2"]), True, self.words(2, 12)))] if r.random() < 0.6 else []
        for _ in range(r.choice([1, 1, 2, 3, 5])):
            out.append((True, lambda: self.run(True, brief)))
            x = r.random()
            if x < 0.2:
                out += [(False, lambda: self.paragraph(True))] * r.choice([1, 1, 2, 4])
            elif x < 0.4:
                out.append((False, lambda: self.noise(r.choice(["ad", "share", "form", "sidebar", "notice", "nav"]))))
            elif x < 0.5:
                out.append((False, lambda: self.el(r.choice(["h2", "h3"]), True, self.words(1, 8))))
            elif x < 0.6:
                out.append((False, lambda: self.el("ul", True, lambda: "".join(self.el("li", True, self.words(2, 25)) for _ in range(r.randint(2, 5))))))
            elif x < 0.65:
                out.append((False, lambda: self.el(r.choice(["blockquote", "pre"]), True, self.words(5, 40))))
        return out

    def loose(self) -> str:
        """A page with text right in its body: the article, or what stands around one."""
        r = self.r
        self.kept.append(True)  # the root
        if r.random() < 0.06:
            return self.run(True, r.random() < 0.5)
        top = [k for k in ("header", "nav", "ad", "notice", "form") if r.random() < 0.35]
        end = [k for k in ("sidebar", "comments", "ad", "share", "notice", "form", "footer") if r.random() < 0.35]
        r.shuffle(top)
        parts = [(False, lambda k=k: self.noise(k)) for k in top]
        parts += [(True, lambda: self.run(False))] if r.random() < 0.35 else []
        parts += self.loose_parts() if r.random() < 0.65 else [(False, self.core)]
        parts += [(True, lambda: self.run(False))] if r.random() < 0.35 else []
        parts += [(False, lambda k=k: self.noise(k)) for k in end]
        out, after_run = "", False
        for is_run, make in parts:
            out += ("<hr>" if after_run and is_run else "") + make()
            after_run = is_run
        return out


def labelled_page(seed: int, meaningless: bool = False) -> tuple[str, list[bool]]:
    """A page and, for the root and every block element in page order, whether it holds main text; with `meaningless` its names say nothing."""
    maker = _Maker(seed, meaningless)
    return maker.page(), maker.kept


def loose_page(seed: int, meaningless: bool = False) -> tuple[str, list[bool]]:
    """As labelled_page, with runs of text right in the body, each with its own label."""
    maker = _Maker(seed, meaningless)
    return maker.loose(), maker.kept
