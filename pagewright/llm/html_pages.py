"""A tolerant block tree of HTML, and made-up training pages with known main text.

Only block-level elements become nodes. Inline mark-up stays inside its block's text; scripts, styles, comments and the head have no
text at all. Missing end tags are supplied the usual way (p, li, table cells and options end at the next one or at a block).
"""

from __future__ import annotations

import html as entities
import random
import re

TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|$)", re.S)
ATTR = re.compile(r"""(class|id|role|itemprop|style|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
RAW = frozenset("script style noscript template textarea title iframe svg math select object head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul button label".split()
)
#: A start tag ends open elements of these names, up to the nearest of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "option": ({"option"}, {"select"}),
}
NOT_IN_P = BLOCKS - {"button", "label", "option", "optgroup", "html", "body", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary", "figcaption", "caption"}
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "words", "up", "kids", "text", "links", "depth", "hidden")

    def __init__(self, tag: str, words: str, up: Node | None, hidden: bool = False):
        self.tag, self.words, self.up, self.hidden = tag, words, up, hidden
        self.kids: list[Node] = []  # nodes, in page order; tag "#text" holds a block's own text
        self.text: list[str] = []
        self.links = 0
        self.depth = up.depth + 1 if up else 0


def parse(page: str) -> Node:
    root = at = Node("#root", "", None)
    pieces: list[str] = []
    link, linked, pos = 0, 0, 0

    def flush():
        nonlocal linked
        if pieces:
            text = SPACE.sub(" ", "".join(pieces)).strip()
            if text:
                leaf = Node("#text", "", at)
                leaf.text, leaf.links = [text], min(linked, len(text))
                at.kids.append(leaf)
            pieces.clear()
        linked = 0

    n = len(page)
    while pos <= n:
        m = TAG.search(page, pos)
        piece = page[pos : m.start() if m else n]
        if piece:
            piece = entities.unescape(piece) if "&" in piece else piece
            pieces.append(piece)
            linked += len(piece) if link else 0
        if not m:
            break
        pos = max(m.end(), pos + 1)
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "a":
                link = 0
            elif name in BLOCKS:
                up = at
                while up is not root and up.tag != name:
                    up = up.up
                if up is not root:
                    flush()
                    at = up.up
            continue
        if name in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{name}\s*>", re.I).search(page, pos)
            if name == "head" and not end:
                continue
            pos = end.end() if end else (n if name in ("script", "style", "textarea", "title") else pos)
            pieces.append(" " if name in ("head", "select", "textarea", "iframe", "object") else "")
        elif name == "br":
            pieces.append(" ")
        elif name == "hr":
            flush()
        elif name == "a":
            link = 1
        elif name in BLOCKS:
            flush()
            if name in ENDS:
                stop, limit = ENDS[name]
                up, last = at, None
                while up is not root and up.tag not in limit:
                    last = up if up.tag in stop else last
                    up = up.up
                at = last.up if last else at
            elif name in NOT_IN_P:
                up = at
                while up is not root and up.tag != "p" and up.tag not in ("div", "td", "li", "article", "section", "body", "main", "button"):
                    up = up.up
                at = up.up if up.tag == "p" else at
            words, hidden = "", False
            if m[3]:
                for key, value in ATTR.findall(m[3]):
                    key, value = key.lower(), value.strip("\"'").lower()
                    if key in ("class", "id", "role", "itemprop"):
                        words += " " + value
                    elif key == "style":
                        hidden |= "display:none" in value.replace(" ", "")
                    else:
                        hidden |= value != "false"
            node = Node(name, words, at, hidden)
            at.kids.append(node)
            if name not in VOID and not m[3].endswith("/"):
                at = node
    flush()
    return root


# ---- training pages

GOOD_CLASSES = ("article", "post", "post-content", "entry-content", "article-body", "story", "content", "main-content", "text-body", "page-content", "blog-post", "news-text", "c12", "x7", "")
BAD = (
    ("nav", "menu main-nav navbar nav topnav breadcrumb breadcrumbs pager pagination"), ("header", "header site-header masthead top banner-top branding"),
    ("footer", "footer site-footer bottom copyright legal colophon"), ("aside", "sidebar side widget related right-rail related-posts recommended more-stories"),
    ("ad", "ad ads advert advertisement sponsored promo banner adsbox"), ("notice", "cookie cookie-notice notice consent gdpr alert popup modal overlay"),
    ("form", "form subscribe newsletter signup search login search-form"), ("comments", "comments comment-list disqus responses replies reader-comments comment"),
    ("share", "share social share-buttons tags meta-links"),
)


def training_page(r: random.Random) -> list:
    """A page as a tree of [tag, class, kids or text, good, link]: good is True for main text, False for the rest, None where mixed."""
    vocab = ["".join(r.choices("abcdefghijklmnopqrstuvwxyzäéß", k=r.randint(1, 9))) for _ in range(80)]

    def words(lo, hi):
        out = [r.choice(vocab) + ("," if r.random() < 0.06 else "." if r.random() < 0.1 else "") for _ in range(r.randint(lo, hi))]
        return " ".join(out).capitalize() + ("." if hi > 12 and r.random() < 0.9 else "")

    def bad(kind, names):
        cls = r.choice(names.split()) if r.random() < 0.85 else ""
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "div")
        tag = tag if not cls or r.random() < 0.6 else r.choice(("div", "section", "ul" if kind == "nav" else "div"))
        if not cls and tag == "div":
            cls = names.split()[0]
        if kind == "nav" or kind == "share":
            items = [["li", "", words(1, 3), False, True] for _ in range(r.randint(2, 14))]
            kids = items if tag == "ul" else [["ul", "", items, False, False]]
        elif kind == "form":
            kids = [[r.choice(("label", "p", "div")), "", words(1, 6), False, False] for _ in range(r.randint(1, 4))] + [["button", "", words(1, 2), False, False]]
        elif kind == "comments":
            kids = [["h3", "", words(1, 3), False, False]] + [[r.choice(("div", "li", "article", "p")), r.choice(("comment", "reply", "")), [["p", "", words(4, 60), False, False]], False, False] for _ in range(r.randint(1, 6))]
        elif kind == "aside":
            kids = [["h3", "", words(1, 4), False, False], ["ul", "", [["li", "", words(2, 9), False, r.random() < 0.8] for _ in range(r.randint(2, 8))], False, False]]
            if r.random() < 0.3:
                kids = [["p", "", words(5, 40), False, False] for _ in range(r.randint(1, 3))]
        else:
            kids = words(2, 25 if kind in ("notice", "ad", "footer") else 10) if r.random() < 0.6 else [["p", "", words(2, 25), False, r.random() < 0.4] for _ in range(r.randint(1, 3))]
        return [tag, cls, kids, False, False]

    body = [["h1", "", words(2, 10), True, False]] if r.random() < 0.85 else []
    for _ in range(r.choice((1, 1, 2, 3, 4, 6, 8, 12, 20))):
        k = r.random()
        if k < 0.76:
            body.append(["p", r.choice(("", "", "", "lead", "text")), words(1, r.choice((3, 12, 40, 90, 200))), True, r.random() < 0.03])
        elif k < 0.84:
            body.append([r.choice(("h2", "h3")), "", words(1, 8), True, False])
        elif k < 0.9:
            body.append([r.choice(("ul", "ol")), "", [["li", "", words(2, 25), True, r.random() < 0.1] for _ in range(r.randint(2, 6))], True, False])
        elif k < 0.94:
            body.append(["blockquote", "", [["p", "", words(5, 50), True, False]], True, False])
        elif k < 0.97:
            body.append(["table", "", [["tr", "", [["td", "", words(1, 6), True, False] for _ in range(3)], True, False] for _ in range(r.randint(1, 4))], True, False])
        else:
            body.append(["pre", "", words(5, 40), True, False])
    inner = True
    if r.random() < 0.35:
        body.insert(r.randint(1, len(body)), bad(*r.choice(BAD[3:])))
        inner = None
    tag = r.choice(("article", "article", "main", "div", "div", "section"))
    cls = r.choice(GOOD_CLASSES if tag != "div" else GOOD_CLASSES[:-1])
    node = [tag, cls, body, inner, False]
    for _ in range(r.choice((0, 0, 1, 2))):
        node = [r.choice(("div", "main", "section")), r.choice(("wrapper", "container", "content", "row", "page", "")), [node] + ([bad(*r.choice(BAD[3:]))] if r.random() < 0.4 else []), None, False]
    before = [bad(*b) for b in r.sample((BAD[0], BAD[1], BAD[4], BAD[5], BAD[6]), r.randint(1, 3))]
    after = [bad(*b) for b in r.sample((BAD[2], BAD[3], BAD[4], BAD[5], BAD[7], BAD[8]), r.randint(1, 4))]
    return ["body", "", [*before, node, *after], None, False]


def training_tree(r: random.Random) -> tuple[Node, dict[int, bool | None]]:
    """The block tree of a training page and good by node."""
    good: dict[int, bool | None] = {}

    def build(x, up):
        tag, cls, kids, fine, link = x
        node = Node(tag, cls, up)
        good[id(node)] = fine
        up.kids.append(node)
        if isinstance(kids, str):
            leaf = Node("#text", "", node)
            leaf.text, leaf.links = [kids], len(kids) if link else 0
            node.kids.append(leaf)
            good[id(leaf)] = fine
        else:
            for k in kids:
                build(k, node)

    root = Node("#root", "", None)
    good[id(root)] = None
    build(training_page(r), root)
    return root, good
