"""Main text of web pages through wrappers inferred from pages of the same host.

A page is a stream of tokens: tags with their class, id and role, and text. Equal
neighbouring stretches are folded into repeated groups, which leaves a union-free
regular expression of the page. Expressions of one host are aligned one after another:
tokens that only one side has become optional groups, texts that differ become slots,
repeated groups align inside. The wrapper that results tells for every slot where it
stands and whether its text is the same on all pages, and so which slots hold the
article.

Pages with the same expression are one row before any alignment, and expressions of a
host are aligned in small groups, round by round, so a host may hold any share of the pages.
"""

from __future__ import annotations

import html
import json
import re
import sys
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysieve.llm import common as K

#: Longest stretch of tokens that folding looks for at first; found groups fold further.
PERIOD = 24
#: Expressions, then wrappers, of a host that one group aligns on average.
GROUP = 64
#: Cells of a table of common runs that alignment fills at most; larger ones are split, with two rows at a time.
CELLS = 1 << 18
TEXT = "#"

# HTML's elements without content, with raw content, inside lines, and what closes a paragraph.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template svg math select xmp noembed noframes".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr img".split()
)
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5"
    " h6 header hr main menu nav ol p pre section summary table ul".split()
)
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

# Elements, roles and name parts of what surrounds an article, and of articles.
_AROUND = frozenset("head nav footer aside form button dialog menu fieldset legend input object applet canvas audio video".split()) | _RAW
_AROUND_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_AROUND_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements adsense adbox banner promo promos promotion sponsor sponsors sponsored nav"
    " navbar navigation menu menus breadcrumb breadcrumbs footer sidebar sidebars aside notice notices cookie cookies consent gdpr"
    " alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended"
    " recommendations comment comments reply replies respond discussion disqus widget widgets toolbar pagination pager copyright"
    " disclaimer form skip commentlist usercomment usercomments readercomments adslot adunit adblock adcontainer cookiebar"
    " cookiebanner topnav sidenav subnav searchbox searchform".split()
)
#: An article or main part of these names is a reader's or an advertiser's.
_NOT_MAIN = frozenset("comment comments reply replies respond discussion ad ads advert adverts advertisement sponsored promo".split())
_HEADER = frozenset(("header", "masthead", "topbar"))
#: Parts of a name that tell of a page's state or subject, not of what the element is.
_STATES = frozenset("has no not with without is are hide hidden show open closed status type format category cat tag tags term topic".split())
_BOXES = frozenset("wrap wrapper container inner outer area box holder block section list item body".split())
_CONTENT = frozenset("article post entry story main content page maintext".split())
#: How an element stands around the article: by a name that an article inside undoes, by its name, by its kind.
_CLEAR, _UNDONE, _NAMED_SO, _KIND_SO = range(4)
_REGIONS = (
    lambda tag, role, names: tag == "article" or role == "article",
    lambda tag, role, names: tag == "main" or role == "main",
    lambda tag, role, names: not names.isdisjoint(("article", "post", "entry", "story", "main", "content", "body", "maintext")) and tag != "body",
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_BLANK = " \t\n\r\f\v                 　\u0085"


def tokens(page: str) -> list[tuple[str, str]]:
    """(key, text) of every token; a tag's key is its name with class, id and role, a text's is ``#``.

    Comments and declarations are left out. What stands inside scripts and the like
    belongs to their tag. Texts of white space alone are kept as texts only between
    inline elements, where they part words.
    """
    out: list[tuple[str, str]] = []
    at, end = 0, len(page)

    def text(upto: int) -> None:
        if upto > at:
            raw = page[at:upto]
            if out and out[-1][0] == TEXT:
                out[-1] = TEXT, out[-1][1] + raw
            elif raw.strip(_BLANK):
                out.append((TEXT, raw))
            elif out:
                # White space goes with the text before it, if an inline tag stands between.
                out.append((" ", raw))

    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            text(end)
            break
        text(m.start())
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                inner = m[0][9:].removesuffix("]]>")
                if inner:
                    out.append((TEXT, html.escape(inner, quote=False)))
            continue
        name = m[2].lower()
        if m[1]:
            out.append((f"/{name}", ""))
            continue
        named = sorted((k.lower(), _plain((a or b or c).lower())) for k, a, b, c in _NAMED.findall(m[3])) if "=" in m[3] else []
        out.append((" ".join([name, *(f"{k}={v}" for k, v in named)]), ""))
        if name in _RAW and not m[3].endswith("/"):
            close = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            out.append((f"/{name}", ""))
    return out


def _plain(names: str) -> str:
    """Names without numbers: ``post-123`` is ``post``, as on the host's other pages."""
    if not re.search(r"\d", names):
        return " ".join(names.split())
    parts = (re.sub(r"(?<![^\W_])[a-z]*\d[^\W_]*", lambda m: re.fullmatch(r"([a-z]*)\d+|.*", m[0])[1] or "", x).strip("-_") for x in names.split())
    return " ".join(x for x in parts if x)


class Folder:
    """Folds token keys into nested repeated groups; keys and groups are single characters meanwhile."""

    def __init__(self) -> None:
        self._char: dict[str, str] = {}
        self._meaning: dict[str, str | tuple[str]] = {}
        self._folds = [re.compile(rf"(.{{{p}}})\1+", re.S) for p in range(1, PERIOD + 1)]

    def _of(self, meaning) -> str:
        if meaning not in self._char:
            made = chr(0xF0000 + len(self._char))
            self._char[meaning], self._meaning[made] = made, meaning
        return self._char[meaning]

    def fold(self, keys: list[str]) -> list:
        """Items: a key, or a list of items that repeats one or more times."""
        if len(self._char) > 50_000:
            self._char.clear()
            self._meaning.clear()
        line = "".join(map(self._of, keys))
        while True:
            before, groups = line, set()

            def group(m: re.Match) -> str:
                groups.add(m[1])
                return self._of((m[1],))

            for fold in self._folds:
                line = fold.sub(group, line)
                for body in groups:
                    line = line.replace(body, self._of((body,)))
                groups.clear()
            if line == before:
                return self._spelt(line)

    def _spelt(self, line: str) -> list:
        return [self._spelt(m[0]) if isinstance(m := self._meaning[c], tuple) else m for c in line]


def slots_of(items: list, keys: list[str]) -> list[int]:
    """For each token the number of its text slot in ``items``, -1 for tags; groups repeat as long as they fit."""
    numbered: dict[int, int] = {}

    def number(own: list, path: tuple = ()) -> None:
        for i, x in enumerate(own):
            if isinstance(x, list):
                number(x, (*path, i))
            elif x == TEXT:
                numbered[(*path, i)] = len(numbered)

    number(items)
    out = [-1] * len(keys)

    def match(own: list, at: int, path: tuple) -> int:
        for i, x in enumerate(own):
            if isinstance(x, list):
                nxt = match(x, at, (*path, i))
                if nxt < 0:
                    return -1
                while nxt > at:
                    at = nxt
                    nxt = match(x, at, (*path, i))
            elif at < len(keys) and keys[at] == x:
                out[at] = numbered[(*path, i)] if x == TEXT else -1
                at += 1
            else:
                return -1
        return at

    match(items, 0, ())
    return out


class Slot:
    """A text slot of a wrapper: smallest and largest hash of its texts, and of all texts of the pages that have it."""

    __slots__ = ("low", "high", "pages", "least", "most")

    def __init__(self, low: int, high: int, pages: int, least: int = 0, most: int = 0):
        self.low, self.high, self.pages, self.least, self.most = low, high, pages, least, most

    def alike(self) -> bool:
        """Whether pages of different contents agree on the text; copies of one page say nothing."""
        return self.low == self.high and self.least != self.most


def _kind(item) -> str:
    own = item[0]
    return "+" + _kind(own[0]) if isinstance(own, list) else own


def align(a: list, b: list) -> list:
    """Wrapper of both; items are (key or list of items, optional, slot or None).

    The longest common run of kinds stays; what only one side has becomes optional.
    """
    ka, kb = [_kind(x) for x in a], [_kind(x) for x in b]
    if ka == kb:
        return [_both(x, y) for x, y in zip(a, b)]
    out, i, j = [], 0, 0
    for x, y in [*_common(ka, kb), (len(a), len(b))]:
        out += [(k, True, slot) for k, _, slot in a[i:x]] + [(k, True, slot) for k, _, slot in b[j:y]]
        if x < len(a):
            out.append(_both(a[x], b[y]))
        i, j = x + 1, y + 1
    return out


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common run of both, in order; memory grows with their length only."""
    number: dict[str, int] = {}
    a, b = (np.array([number.setdefault(x, len(number)) for x in own], np.int64) for own in (a, b))
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if i == n or j == m:
            continue
        if (n - i) * (m - j) <= CELLS:
            out += [(i + x, j + y) for x, y in _table_run(a[i:n].tolist(), b[j:m].tolist())]
        elif n - i == 1:
            out += [(i, j + int(y)) for y in np.flatnonzero(b[j:m] == a[i])[:1]]
        else:
            half = (i + n) // 2
            both = _last_row(a[i:half], b[j:m]) + _last_row(a[half:n][::-1], b[j:m][::-1])[::-1]
            at = j + int(np.argmax(both))
            todo += [(i, half, j, at), (half, n, at, m)]
    return sorted(out)


def _last_row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common run of ``a`` and each start of ``b``."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        new = row.copy()
        np.maximum(row[1:], row[:-1] + (b == x), out=new[1:])
        row = np.maximum.accumulate(new)
    return row


def _table_run(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i] == b[j] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _both(x: tuple, y: tuple) -> tuple:
    own, slot = x[0], x[2]
    if isinstance(own, list):
        own = align(own, y[0])
    elif slot is not None:
        z = y[2]
        slot = Slot(min(slot.low, z.low), max(slot.high, z.high), slot.pages + z.pages, min(slot.least, z.least), max(slot.most, z.most))
    return own, x[1] or y[1], slot


def wrapper_of(items: list, lows: list[int], highs: list[int], pages: int, least: int = 0, most: int = 0) -> list:
    """A page expression as a wrapper, with its slots' text hashes and the smallest and largest hash of its pages."""
    at = iter(zip(lows, highs))

    def build(own: list) -> list:
        return [
            (build(x), False, None) if isinstance(x, list) else (x, False, Slot(*next(at), pages, least, most) if x == TEXT else None)
            for x in own
        ]

    return build(items)


def _dump(wrapper: list) -> list:
    return [[_dump(x) if isinstance(x, list) else x, opt, s and [int(getattr(s, k)) for k in Slot.__slots__]] for x, opt, s in wrapper]


def _load(stored: list) -> list:
    return [(_load(x) if isinstance(x, list) else x, opt, s and Slot(*s)) for x, opt, s in stored]


def _says(names: str, wanted: frozenset) -> bool:
    """Whether a class or id is one of ``wanted``, or starts or ends with one as its names usually do.

    Numbers and boxes at the end are left out, if no part means content: ``content-sidebar-wrap``
    holds more than a sidebar. ``has-sidebar`` and ``no-comments`` say nothing of the element.
    """
    for name in names.split():
        parts = [x for x in re.split(r"[^a-z0-9]+", name) if x and not x.isdigit()]
        if not parts or not _STATES.isdisjoint(parts):
            continue
        if _CONTENT.isdisjoint(parts):
            while len(parts) > 1 and parts[-1] in _BOXES:
                parts.pop()
        if parts[0] in wanted or parts[-1] in wanted:
            return True
    return False


def _contexts(wrapper: list) -> list[tuple[Slot, int, list[bool]]]:
    """Of each slot: itself, how it stands around the article, and in which kind of region it is; last, whether in a title.

    An article or main part undoes the names of what it stands in.
    """
    out, stack = [], []

    def close(names: tuple[str, ...], stop: frozenset = frozenset()) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                del stack[k:]
                return
            if stack[k][0] in stop:
                return

    def walk(own: list) -> None:
        for key, _, slot in own:
            if isinstance(key, list):
                walk(key)
            elif slot is not None:
                inside = [any(s[2][r] for s in stack) for r in range(len(_REGIONS))]
                title = any(s[0] in ("h1", "h2") for s in stack)
                article = max((k for k, s in enumerate(stack) if any(s[2][:2])), default=-1)
                around = _CLEAR
                for k, s in enumerate(stack):
                    own = max(s[1], _CLEAR if any(inside[:2]) else s[3])
                    around = max(around, _UNDONE if own == _NAMED_SO and k < article else own)
                out.append((slot, around, [*inside, title]))
            elif key.startswith("/"):
                close((key[1:],))
            elif key != " ":
                name, _, rest = key.partition(" ")
                fields = dict(re.findall(r"(class|id|role)=((?:(?! (?:class|id|role)=).)*)", rest))
                names = fields.get("class", "") + " " + fields.get("id", "")
                parts = frozenset(re.split(r"[^a-z0-9]+", names))
                role = fields.get("role", "")
                if name in _ENDS_P:
                    close(("p",), frozenset(("button", "table", "td", "th", "div", "article", "section")))
                if name in _SIBLINGS:
                    close(_SIBLINGS[name], frozenset(("ul", "ol", "dl", "table")))
                if name not in _VOID:
                    if name in ("html", "body"):
                        around = _CLEAR
                    elif name in ("article", "main"):
                        around = _NAMED_SO if _says(names, _NOT_MAIN) else _CLEAR
                    elif name in _AROUND or role in _AROUND_ROLES:
                        around = _KIND_SO
                    else:
                        around = _NAMED_SO if _says(names, _AROUND_NAMES) else _CLEAR
                    header = _KIND_SO if name == "header" else _NAMED_SO if name != "body" and _says(names, _HEADER) else _CLEAR
                    stack.append((name, around, [r(name, role, parts) and not around for r in _REGIONS], header))

    walk(wrapper)
    return out


def _template(wrapper: list) -> Callable[[Slot | None], bool]:
    """Test whether a slot of the wrapper holds a line of the host's template.

    Such a line is the same on all pages that have it, whose contents differ, and at
    least half of the host's pages have it, three or more. A shared quotation is on fewer.
    """

    def most(items: list) -> int:
        return max((most(x) if isinstance(x, list) else slot.pages if slot else 0 for x, _, slot in items), default=0)

    least = max(3, -(-most(wrapper) // 2))
    return lambda slot: slot is not None and slot.pages >= least and slot.alike()


def chosen(wrapper: list, own: list) -> list[bool]:
    """Which slots of ``own``, an expression that the host's ``wrapper`` covers, hold the article.

    Those inside an article, else a main part, else a part named like one; in a host
    without such, all but those that pages of different contents agree on. What stands around articles never.
    Inside a region a line of the host's template goes too, while the larger part of the region's slots is the page's own.
    """
    # Aligning the expression with the wrapper pairs each of its slots with the wrapper's.
    paired: dict[int, Slot] = {}

    def pair(a: list, b: list) -> None:
        for i, j in _common([_kind(x) for x in a], [_kind(x) for x in b]):
            if isinstance(a[i][0], list):
                pair(a[i][0], b[j][0])
            elif a[i][2] is not None:
                paired[id(a[i][2])] = b[j][2]

    pair(own, wrapper)
    slots = _contexts(own)
    # A part whose surroundings' names are undone counts only where no other article or main part is.
    for r, most in ((0, _CLEAR), (1, _CLEAR), (0, _UNDONE), (1, _UNDONE), (2, _CLEAR)):
        flags = [around <= most and inside[r] for _, around, inside in slots]
        if any(flags):
            template = _template(wrapper)
            own = [f and (inside[-1] or not template(paired.get(id(slot)))) for f, (slot, _, inside) in zip(flags, slots)]
            return own if 2 * sum(own) > sum(flags) else flags
    own_text = [not paired.get(id(slot), slot).alike() for slot, _, _ in slots]
    for most in (_CLEAR, _NAMED_SO):
        flags = [around <= most and text for (_, around, _), text in zip(slots, own_text)]
        if any(flags):
            break
    return flags


def _host(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", url or "")
    return m[1].lower() if m else ""


def _text_hash(text: str) -> int:
    raw = " ".join(text.split()).encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) | zlib.crc32(raw[::-1]) << 31


def _expressions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(host, expression, pages, least, most, low, high): pages of a batch with one expression are one row."""
    folder = Folder()
    for frame in frames:
        seen: dict[tuple[str, str], list] = {}
        for url, page in zip(frame["url"], frame["html"]):
            stream = tokens(page if isinstance(page, str) else "")
            keys = [k for k, _ in stream]
            items = folder.fold(keys)
            low: dict[int, int] = {}
            high: dict[int, int] = {}
            for slot, (_, text) in zip(slots_of(items, keys), stream):
                if slot >= 0:
                    h = _text_hash(text)
                    low[slot], high[slot] = min(low.get(slot, h), h), max(high.get(slot, h), h)
            lows, highs = [low[i] for i in sorted(low)], [high[i] for i in sorted(high)]
            whole = _text_hash("\0".join(" ".join(t.split()) for k, t in stream if k == TEXT))
            key = _host(url if isinstance(url, str) else None), json.dumps(items, separators=(",", ":"))
            if key in seen:
                own = seen[key]
                own[:3] = own[0] + 1, min(own[1], whole), max(own[2], whole)
                own[3] = list(map(min, own[3], lows))
                own[4] = list(map(max, own[4], highs))
            else:
                seen[key] = [1, whole, whole, lows, highs]
        yield pd.DataFrame([(h, e, *v) for (h, e), v in seen.items()], columns=["host", "expression", "pages", "least", "most", "low", "high"])


def _aligned(parts: Iterator[list]) -> str:
    whole = None
    for wrapper in parts:
        whole = wrapper if whole is None else align(whole, wrapper)
    return json.dumps(_dump(whole or []), separators=(",", ":"))


_OWN = ("expression", "low", "high", "pages", "least", "most")


def _own_wrapper(expression: str, low, high, pages: int, least: int, most: int) -> list:
    return wrapper_of(json.loads(expression), list(low), list(high), int(pages), int(least), int(most))


def _part_wrapper(frame: pd.DataFrame) -> pd.DataFrame:
    """Wrapper of one group of a host's expressions, the most frequent first."""
    rows = frame.sort_values(["pages", "expression"], ascending=[False, True])
    made = (_own_wrapper(*row) for row in zip(*(rows[c] for c in _OWN)))
    return pd.DataFrame({"host": frame["host"].iloc[:1], "salt": frame["salt"].iloc[:1], "wrapper": [_aligned(made)]})


def _host_wrapper(frame: pd.DataFrame) -> pd.DataFrame:
    rows = frame.sort_values("salt")
    return pd.DataFrame({"host": frame["host"].iloc[:1], "salt": frame["salt"].iloc[:1] // GROUP, "wrapper": [_aligned(_load(json.loads(w)) for w in rows["wrapper"])]})


def infer(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, expression, choice) for every expression of ``pages`` (url, html), and (host, wrapper)."""
    found = pages.select("url", "html").mapInPandas(
        _expressions, "host string, expression string, pages long, least long, most long, low array<long>, high array<long>"
    )
    # Slot hashes are merged by position: one row for each slot, then one for each expression.
    exploded = found.select("host", "expression", "pages", "least", "most", F.posexplode_outer(F.arrays_zip("low", "high")).alias("slot", "h"))
    merged = exploded.groupBy("host", "expression", "slot").agg(
        F.min("h.low").alias("low"), F.max("h.high").alias("high"), F.sum("pages").alias("pages"),
        F.min("least").alias("least"), F.max("most").alias("most"),
    )
    expressions = K.settled(
        merged.groupBy("host", "expression").agg(
            F.max("pages").alias("pages"), F.min("least").alias("least"), F.max("most").alias("most"), F.sort_array(F.collect_list(F.struct("slot", "low", "high"))).alias("slots")
        ).select(
            "host", "expression", "pages", "least", "most", F.filter("slots.low", lambda x: x.isNotNull()).alias("low"),
            F.filter("slots.high", lambda x: x.isNotNull()).alias("high"),
        )
    )
    groups = expressions.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("groups"))
    most = groups.agg(F.max("groups")).first()[0] or 1
    wrappers = K.settled(
        expressions.join(groups, "host").withColumn("salt", F.pmod(F.xxhash64("expression"), F.col("groups"))).drop("groups")
        .groupBy("host", "salt").applyInPandas(_part_wrapper, "host string, salt long, wrapper string")
    )
    # Wrappers of groups are aligned in groups again, until each host has one.
    while most > 1:
        most = -(-most // GROUP)
        place = F.floor(F.col("salt") / GROUP).alias("place")
        wrappers = K.settled(wrappers.groupBy("host", place).applyInPandas(_host_wrapper, "host string, salt long, wrapper string"))
    wrappers = wrappers.select("host", "wrapper")

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            choices, known = [], {}
            for host, w, *own in zip(*(frame[c] for c in ("host", "wrapper", *_OWN))):
                if host not in known:
                    known.clear()
                    known[host] = _load(json.loads(w))
                choices.append([bool(x) for x in chosen(known[host], _own_wrapper(*own))])
            yield pd.DataFrame({"host": frame["host"], "expression": frame["expression"], "choice": choices})

    choices = expressions.join(wrappers, "host").mapInPandas(choose, "host string, expression string, choice array<boolean>")
    return K.settled(choices), wrappers


def _pieces(page: str, folder: Folder) -> tuple[str, list[int], list[int], list[str]]:
    """Expression of a page, and its texts with their slots and the number of the block each is in."""
    stream = tokens(page)
    keys = [k for k, _ in stream]
    items = folder.fold(keys)
    slot, block, text, now = [], [], [], 0
    for own, (key, raw) in zip(slots_of(items, keys), stream):
        if key == TEXT or key == " ":
            slot.append(own)
            block.append(now)
            text.append(html.unescape(raw))
        elif key == "br":
            # A line break parts words inside its block.
            slot.append(-1)
            block.append(now)
            text.append(" ")
        elif key.partition(" ")[0].removeprefix("/") not in _INLINE:
            now += 1
    return json.dumps(items, separators=(",", ":")), slot, block, text


def article(slot: list[int], block: list[int], text: list[str], choice: list[bool]) -> str:
    """Texts of the chosen slots: white space in a block is one space, blocks are joined by one."""
    blocks: dict[int, list[str]] = {}
    for s, b, t in zip(slot, block, text):
        if s < 0:
            if b in blocks:
                blocks[b].append(t)
        elif s < len(choice) and choice[s]:
            blocks.setdefault(b, []).append(t)
    return " ".join(x for x in (" ".join("".join(own).split()) for own in blocks.values()) if x)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, host) for every row of ``pages`` (page_id, url, html).

    A null html is empty and has no text; pages with a null or odd url are one host "".
    """
    choices, _ = infer(K.in_batches(pages))
    id_type = pages.schema["page_id"].dataType.simpleString()

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folder = Folder()
        for frame in frames:
            rows = [_pieces(p if isinstance(p, str) else "", folder) for p in frame["html"]]
            out = pd.DataFrame(rows, columns=["expression", "slot", "block", "piece"])
            out["host"] = [_host(u if isinstance(u, str) else None) for u in frame["url"]]
            out["page_id"], out["url"] = frame["page_id"].to_numpy(), frame["url"].to_numpy()
            yield out

    # Ids travel as text, so that a null among them turns no other into a float.
    sent = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html")
    pieces = sent.mapInPandas(
        read, "expression string, slot array<int>, block array<int>, piece array<string>, host string, page_id string, url string"
    ).withColumn("place", F.xxhash64("host", "expression")).drop("expression")
    by_place = choices.select(F.xxhash64("host", "expression").alias("place"), "choice").dropDuplicates(["place"])

    @F.pandas_udf("string")
    def text(slot: pd.Series, block: pd.Series, piece: pd.Series, choice: pd.Series) -> pd.Series:
        return pd.Series([article(*row) for row in zip(slot, block, piece, choice)], dtype=object)

    joined = pieces.join(by_place, "place").withColumn("text", text("slot", "block", "piece", "choice"))
    return joined.select(F.col("page_id").cast(id_type).alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"), "host")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
