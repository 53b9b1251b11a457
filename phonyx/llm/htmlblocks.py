"""HTML pages as sequences of text blocks, and synthetic pages with known labels.

A block is the text between two block-level tags. It carries the tags and the
class, id and role words of the elements it stands in, nearest last, and the
share of its characters that are link text. The reader is tolerant: unclosed
paragraphs, list items and cells end where the next one begins, stray end tags
are passed over, a tag cut off at the end of the page is dropped. The contents
of scripts, styles, templates and the head are not blocks.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html import escape, unescape
from string import punctuation
from zlib import crc32

import numpy as np

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>|</?[!?/]?[^>a-zA-Z\s=\d&;<'"(][^>]*+>|<[a-zA-Z/!?][^<>]*+\Z""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
HINT = re.compile(r"[a-z]+|[A-Z][a-z]*")

#: Elements whose content is no text of the page.
RAW = frozenset("script style template noscript title textarea iframe svg math object canvas audio video select datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: What an opening tag ends: elements of these names, up to the nearest of the bounding ones.
CLOSES = {
    "li": (frozenset(["li", "p"]), frozenset(["ul", "ol", "menu"])),
    "dd": (frozenset(["dd", "dt", "p"]), frozenset(["dl"])),
    "dt": (frozenset(["dd", "dt", "p"]), frozenset(["dl"])),
    "td": (frozenset(["td", "th", "p"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th", "p"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr", "td", "th", "p"]), frozenset(["table"])),
}
ONLY_P = (frozenset(["p"]), frozenset(["td", "th", "button", "table"]))
EMPTY = frozenset(["hr"])

PATH_SLOTS, WORD_SLOTS = 1 << 10, 1 << 12


def slot(token: str, slots: int) -> int:
    return crc32(token.encode("utf-8", "surrogatepass")) % slots


def remembering(f: Callable, most: int) -> Callable:
    """f with a bounded memory of its answers, which lives as long as the returned function."""
    seen: dict = {}

    def known(*args):
        out = seen.get(args)
        if out is None:
            if len(seen) >= most:
                seen.clear()
            seen[args] = out = f(*args)
        return out

    return known


def hints(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag and the words of an element's class, id and role; attributes of any length count in full."""
    found = [tag]
    for m in ATTRIBUTE.finditer(attributes):
        found += [h.lower() for h in HINT.findall(m[2] or m[3] or m[4] or "")]
    return tuple(dict.fromkeys(found))


def path_slots(path: tuple[tuple[str, ...], ...]) -> tuple[int, ...]:
    """Hashed path: the words of the nearest element, and of the ones around it, apart."""
    own = [f"own {h}" for h in path[-1]] if path else []
    around = [f"in {h}" for element in path[:-1] for h in element] + [f"in {h}" for h in (path[-1] if path else ())]
    return tuple(slot(t, PATH_SLOTS) for t in dict.fromkeys(own + around))


class Memory:
    """What a task remembers between pages."""

    def __init__(self):
        self.hints, self.path_slots = remembering(hints, 1 << 14), remembering(path_slots, 1 << 14)
        self.word_slot = remembering(lambda word: slot(word.lower(), WORD_SLOTS), 1 << 16)


def blocks_of(page: str, memory: Memory) -> list[tuple[tuple[tuple[str, ...], ...], str, float, str]]:
    """(path, text, link share, tag) of every block with text, in page order."""
    out = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    linked, in_link, at, n = 0, False, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append((tuple(h for _, h in stack), text, min(1.0, linked / len(text)), stack[-1][0] if stack else ""))
            pieces.clear()
        linked = 0

    def take(a: int, b: int) -> None:
        nonlocal linked
        piece = page[a:b]
        if "&" in piece:
            piece = unescape(piece)
        pieces.append(piece)
        if in_link:
            linked += len(piece.strip())

    while at < n:
        m = MARKUP.search(page, at)
        if m is None:
            take(at, n)
            break
        if m.start() > at:
            take(at, m.start())
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                flush()
                in_link = False
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
            elif tag == "a":
                in_link = False
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}(?![^\s/>])[^>]*>", re.I).search(page, at)
                at = close.end() if close else n
            pieces.append(" ")
        elif tag in BLOCK:
            flush()
            ends, bound = CLOSES.get(tag, ONLY_P)
            i = len(stack) - 1
            cut = len(stack)
            while i >= 0 and stack[i][0] not in bound:
                if stack[i][0] in ends:
                    cut = i
                i -= 1
            if tag == "body":
                cut = next((k for k, (t, _) in enumerate(stack) if t == "head"), cut)
            del stack[cut:]
            if tag not in EMPTY and not (m[3].endswith("/") and tag in ("div", "p")):
                stack.append((tag, memory.hints(tag, m[3])))
        elif tag == "a":
            in_link = True
        elif tag in ("br", "img", "input", "wbr"):
            pieces.append(" ")
    flush()
    return out


def numbers_of(text: str, link: float, tag: str) -> tuple[float, ...]:
    n = len(text)
    words = text.count(" ") + 1
    return (
        np.log1p(n) / 4, np.log1p(words) / 3, link,
        10 * (text.count(".") + text.count(",") + text.count(";")) / n,
        float(text[-1] in ".!?:;\"'»”"), float(tag[:1] == "h" and tag[1:].isdigit()), float(tag == "p"), float("©" in text),
    )


N_NUMBERS = 8

#: Fixed vocabulary of the synthetic pages: words of classes and ids, and of usual page furniture.
MAIN = "article content post entry story body text main article-body post-content entry-content story-body page-content single prose copy".split()
FURNITURE = {
    "nav": "nav navbar menu navigation breadcrumb breadcrumbs topnav main-menu submenu toc pagination tabs".split(),
    "header": "header masthead top topbar site-header banner-top logo branding".split(),
    "footer": "footer bottom site-footer colophon copyright legal foot".split(),
    "side": "sidebar aside side related widget recommended more-stories popular trending rail secondary complementary".split(),
    "notice": "cookie cookies consent notice alert gdpr banner popup modal overlay paywall message disclaimer warning cookie-notice".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner-ad adslot teaser".split(),
    "form": "form search newsletter subscribe signup login contact-form subscription".split(),
    "comments": "comments comment comment-list commentlist discussion replies responses disqus reader-comments reactions".split(),
    "share": "share social sharing tags follow buttons toolbar".split(),
}
CLAIMS = ("©", "©", "Copyright", "Copyright ©", "(c)")
RESERVED = ("All rights reserved.", "Alle Rechte vorbehalten.", "Tous droits réservés.", "Todos los derechos reservados.", "Imprint and privacy")
TAGS = {"nav": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}
SAID = (
    "Home About Contact Login Search Subscribe Newsletter Privacy Terms Cookies Accept Reject Sponsored Advertisement Related More Read next "
    "Copyright rights reserved Imprint Follow us Share Comments Reply posted Sign up Your email Menu Startseite Impressum Datenschutz Kontakt "
    "Anmelden Suche Kommentare Werbung Accueil Contactez Mentions Recherche Commentaires Publicité Inicio Buscar Aviso Privacidad Comentarios"
).split()


class Pages:
    """Synthetic pages: HTML with the texts of its blocks and whether they belong to the article."""

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)
        parts = ["".join(self.r.choice(list("aeiouäé"), 1)) + "".join(self.r.choice(list("bcdfghklmnprstvw"), int(self.r.integers(1, 3)))) for _ in range(60)]
        self.lexicon = ["".join(self.r.choice(parts, int(self.r.integers(1, 4)))) for _ in range(3000)]

    def any(self, of):
        return of[int(self.r.integers(len(of)))]

    def chance(self, p: float) -> bool:
        return bool(self.r.random() < p)

    def prose(self, most: int) -> str:
        n = max(1, int(most ** self.r.random()))
        words = [self.any(self.lexicon) for _ in range(n)]
        for i in range(n):
            if self.chance(0.1):
                words[i] += self.any(list(".,;"))
        # Junk after words: some run of a punctuation mark or symbol.
        marks = self.any(["", " "]) + self.any(punctuation + "©®§•") * int(self.r.integers(1, 4)) if self.chance(0.5 if n > 4 else 0.25) else ""
        text = " ".join(w + (marks if self.chance(0.5) else "") for w in words)
        return text[0].upper() + text[1:] + ("." if self.chance(0.9) else "")

    def label(self) -> str:
        pool = SAID if self.chance(0.6) else self.lexicon
        return " ".join(self.any(pool) for _ in range(int(self.r.integers(1, 4))))

    def attributes(self, names: list[str], known: float) -> str:
        if self.chance(known):
            name = self.any(names)
            other = f" {self.any(self.lexicon)}" if self.chance(0.3) else ""
            return f' {self.any(["class", "class", "id", "role"])}="{name}{other}"'
        return f' class="{self.any(self.lexicon)}"' if self.chance(0.4) else ""

    def furniture(self, kind: str, known: float) -> None:
        tag = TAGS[kind] if kind in TAGS and self.chance(0.5 * known + 0.1) else self.any(["div", "div", "section"])
        names = FURNITURE[kind]
        bare = tag != "div" and tag != "section"
        self.html.append(f"<{tag}{self.attributes(names, 0.4 if bare else known)}>")
        if kind in ("nav", "share") or kind in ("footer", "side", "header") and self.chance(0.5):
            if self.chance(0.3):
                self.say(self.any(["h2", "h3", "h4"]), self.label(), False)
            self.html.append("<ul>")
            for _ in range(int(self.r.integers(2, 9))):
                self.html.append('<li><a href="/x">')
                self.text(self.label() if self.chance(0.8) else self.prose(12), False)
                self.html.append("</a></li>")
            self.html.append("</ul>")
        if kind == "form":
            self.say("label", self.label(), False)
            self.html.append('<input type="text">')
            self.say("button", self.label(), False)
        if kind == "comments":
            self.say(self.any(["h2", "h3", "h4"]), self.label(), False)
            for _ in range(int(self.r.integers(1, 5))):
                one = self.any(["div", "li", "article"])
                self.html.append(f"<{one}{self.attributes(names, 0.6)}>")
                if self.chance(0.5):
                    self.say("span", self.label(), False)
                for _ in range(int(self.r.integers(1, 3))):
                    self.say("p", self.prose(60), False)
                self.html.append(f"</{one}>")
        elif kind not in ("nav", "share", "form") or self.chance(0.2):
            for _ in range(int(self.r.integers(1, 3))):
                self.say(self.any(["", "p", "p", "div"]), self.prose(40) if self.chance(0.7) else self.label(), False)
        if kind == "footer" and self.chance(0.7):
            name = self.any(self.lexicon).capitalize() + " " + self.any(self.lexicon).capitalize()
            year = f" {int(self.r.integers(1996, 2030))}" if self.chance(0.6) else ""
            tail = self.any(RESERVED) if self.chance(0.6) else self.prose(12)
            self.say("p" if self.chance(0.5) else "", f"{self.any(CLAIMS)}{year} {name}. {tail}", False)
        self.html.append(f"</{tag}>")

    def text(self, text: str, main: bool) -> None:
        self.html.append(escape(text, quote=False))
        self.truth.append((" ".join(text.split()), main))

    def say(self, tag: str, text: str, main: bool) -> None:
        inline = self.any(["", "", "", "b", "em"])
        # Bare text after an unclosed paragraph would go on with it.
        self.html.append((f"<{tag}>" if tag else "</p>" if self.unclosed else "") + (f"<{inline}>" if inline else ""))
        self.unclosed = False
        self.text(text, main)
        if inline and self.chance(0.8):
            self.html.append(f"</{inline}>")
        if tag and not (tag == "p" and self.chance(0.1)):
            self.html.append(f"</{tag}>")
        elif not tag:
            self.html.append("<hr>")
        else:
            self.unclosed = True

    def article(self, known: float) -> None:
        depth = int(self.r.integers(1, 4))
        tags = []
        for _ in range(depth):
            tag = self.any(["article", "main", "div", "div", "section"]) if self.chance(known) else "div"
            tags.append(tag)
            self.html.append(f"<{tag}{self.attributes(MAIN, known if tag == 'div' else 0.3)}>")
        if self.chance(0.85):
            head = self.chance(0.15)
            self.html.append("<header>" if head else "")
            self.say("h1", self.prose(14).rstrip("."), True)
            self.html.append("</header>" if head else "")
        for _ in range(int(self.r.integers(1, 16))):
            kind = self.r.random()
            if kind < 0.66:
                self.say("p", self.prose(160), True)
            elif kind < 0.72:
                self.say(self.any(["h2", "h3", "h4"]), self.prose(8).rstrip("."), True)
            elif kind < 0.82:
                items = self.any(["ul", "ul", "ol"])
                self.html.append(f"<{items}>")
                for _ in range(int(self.r.integers(2, 6))):
                    self.say("li", self.prose(25), True)
                self.html.append(f"</{items}>")
            elif kind < 0.86:
                self.html.append("<table>")
                for _ in range(int(self.r.integers(1, 4))):
                    self.html.append("<tr>")
                    for _ in range(2):
                        self.say(self.any(["td", "td", "th"]), self.prose(12), True)
                self.html.append("</table>")
            elif kind < 0.9:
                self.say(self.any(["blockquote", "pre", "figcaption", "div", "dd", ""]), self.prose(60), True)
            elif kind < 0.97 and known > 0.5:
                self.furniture(self.any(["ad", "side", "share", "notice"]), 1.0)
        if self.chance(0.2) and known > 0.5:
            self.furniture(self.any(["comments", "share", "side"]), 1.0)
        self.html.append("".join(f"</{t}>" for t in reversed(tags)))

    def page(self) -> tuple[str, list[tuple[str, bool]]]:
        self.html, self.truth, self.unclosed = ["<html><head><title>x</title></head><body>"], [], False
        known = float(self.any([0.0, 0.7, 1.0, 1.0]))
        before = [k for k in ("notice", "header", "nav", "ad", "side", "form") if self.chance(0.45)]
        after = [k for k in ("comments", "side", "ad", "share", "form", "footer", "notice") if self.chance(0.45)]
        if known < 0.5:  # without names only the look of a block and its neighbours tell, so no prose of readers there
            before = [k for k in before if k in ("nav", "header")]
            after = [k for k in after if k in ("footer", "share", "form")]
        self.r.shuffle(before)
        wrapped = self.chance(0.4)
        tabled = self.chance(0.12)  # columns laid out as table cells
        self.html.append('<div class="wrapper">' if wrapped else "")
        self.html.append("<table><tr><td>" if tabled else "")
        for k in before:
            self.furniture(k, known)
        self.html.append("</td><td>" if tabled else "")
        if not self.chance(0.03):
            self.article(known)
        self.html.append("</td></tr></table>" if tabled else "")
        for k in after:
            self.furniture(k, known)
        self.html.append("</div>" if wrapped else "")
        return "".join(self.html), self.truth
