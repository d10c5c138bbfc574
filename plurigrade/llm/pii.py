"""Personal data by a skip-chain conditional random field.

Base spans are found by pattern, leftmost and non-overlapping per kind: email, ip (parts at most 255), card (16 to 19
digits, Luhn) and phone (8 to 15 digits); a match that fails its test is dropped.  The nodes of the field are the
document's tokens with a digit, an at sign, marks inside or mixed case, and those that are like a base span.  Neighbouring
nodes are joined by chain potentials.  Tokens that are alike, however far apart, are joined by skip potentials of three sorts:

* same: equal when punctuation and case are dropped, or equal to the local part of an address, what follows an equals
  sign, or the tail of a phone number; tokens in a row that make up a base span are one;
* near: a base span's characters, of which one was changed, added, dropped or moved;
* part: a group of a base card's or phone number's digits, or some groups in a row.

Each node is joined to the next of its likes and to the first of them in a base span of each kind.  Nodes inside base spans
are held at their kind, loopy belief propagation carries their labels along until the messages settle, and a token outside
them that ends up with a kind, and has a like of that kind, becomes a further span.  So does a token that the field takes
for a secret (a key or password named as one), with or without a like.  Base spans always stay.

The potentials are trained by composite likelihood on documents that :func:`practice` makes up, so the model depends on no
corpus and has one size.

Null text is empty and has no spans.  Repeated rows give repeated results, an empty table an empty one.  A very long text is
one graph, linear in its tokens.  Only the id and text columns are read, or the text column of documents that are masked, so
others may have any names.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurigrade.llm.common import map_rows, slices, small_batches

KINDS = ("email", "ip", "card", "phone")
#: What the field may find: the base kinds, and one that has no base spans.  Label 0 is no personal data.
FOUND = (*KINDS, "secret")
LABELS = 1 + len(FOUND)
SECRET = LABELS - 1
Span = tuple[str, int, int]
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits that no dot follows can begin no address, nor can its tails; so both patterns take whole runs only.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_PLAIN = re.compile(r"[^a-z0-9]+")
_RUN = re.compile(r"[0-9]+")
#: Tokens that are nodes whether they are like another or not.
_NODE = re.compile(r"[0-9@]|[^\W_][-._=:/+][^\W_]|[a-z][A-Z]")
#: Words that announce a secret, and shapes of keys that some issuers give out.
_CUE = re.compile(r"(?:token|secret|password|passwd|pwd|credential|bearer|api[-_]?key|(?:access|private|auth|secret)[-_]?(?:key|token))s?", re.I)
_ISSUED = re.compile(r"(?:AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|sk-|sk_live_|xox[abp]-)[A-Za-z0-9_-]{12,}")
_OPEN = re.compile(r"[A-Za-z0-9+/_=~.-]{16,}")
#: A token is like another by what is left of it only if that has so many characters and digits; a base span or its local part needs neither.
LIKE_LENGTH, LIKE_DIGITS = 6, 2
#: Belief that a further span needs, what a round of message passing keeps of the last one, and the change of a message that is none.
BELIEF, DAMPING, SETTLED = 0.7, 0.3, 1e-4
#: Characters that a base span's key needs, and has at most (a mail server takes no longer local part), for tokens to be near it.
NEAR = range(8, 65)
#: Sorts of skip edges.
SAME, NEAR_BY, PART, SORTS = 0, 1, 2, 3
_EDGE = "([{<\"'.,;:!?)]}>"
#: Rounds, beyond one for each node of a document, after which its messages are damped more.
LEAST_ROUNDS = 100


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """The base spans by kind, then start."""
    found = list(_emails(text))
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def like_keys(token: str) -> list[str]:
    """What a token has in common with its likes."""
    keys = []
    for part in {token, token.split("@")[0], token.rsplit("=", 1)[-1]}:
        plain = _PLAIN.sub("", part.lower())
        if len(plain) >= LIKE_LENGTH and sum(c.isdigit() for c in plain) >= LIKE_DIGITS:
            keys.append(plain)
    return sorted(set(keys))


def base_keys(text: str, span: Span) -> list[str]:
    """What a base span has in common with its likes: all its characters, the local part of an address, the tails of a phone number."""
    kind, a, b = span
    whole = text[a:b]
    plain = {_PLAIN.sub("", part.lower()) for part in ([whole, whole.split("@")[0]] if kind == "email" else [whole])}
    if kind == "phone":
        plain |= {key[i:] for key in plain for i in range(len(key) - TAIL + 1)}
    return sorted(plain - {""})


#: Digits of the longest card, and those that the tail of a phone number needs.
LONGEST_RUN, TAIL = 19, 7


def groups_of(kind: str, whole: str) -> list[str]:
    """The groups of a card's or phone number's digits, each of three or more, and runs of some groups, but not all."""
    runs = _RUN.findall(whole)
    if len(runs) == 1:
        one = runs[0]
        runs = [one[i : i + 4] for i in range(0, len(one), 4)] if kind == "card" else [one[:-10], one[-10:-7], one[-7:-4], one[-4:]]
    joined = ("".join(runs[i:j]) for i in range(len(runs)) for j in range(i + 1, min(len(runs), i + LONGEST_RUN) + 1) if j - i < len(runs))
    return sorted({x for x in joined if len(x) >= 3})


def _shorter(word: str) -> Iterator[str]:
    """The word without one of its characters."""
    return (word[:i] + word[i + 1 :] for i in range(len(word)))


FEATURES = 24


def token_features(token: str, cued: bool = False) -> list[float]:
    """What is seen of a token; ``cued`` if a word before it announces a secret."""
    digits = "".join(c for c in token if c in "0123456789")
    n = len(token)
    letters = sum(c.isalpha() for c in token)
    bare = token.strip(_EDGE)
    name, sign, value = bare.rpartition("=")
    value = value.strip(_EDGE) if sign and not cued else bare.strip("=\"'")
    cued = cued or bool(sign and _CUE.fullmatch(name.strip(_EDGE)))
    mixed = bool(_OPEN.fullmatch(value)) and sum(c.isdigit() for c in value) >= 3 and any(c.isalpha() for c in value) and "." not in value
    quad = re.split(r"[.-]", bare)
    inner = bool(re.search(r"[^\W_][-._][^\W_]", bare))
    word = bare.isalpha()
    return [
        1.0, min(len(digits), 20) / 20, len(digits) / n, letters / n, float("@" in token), min(token.count("."), 4) / 4, min(token.count("-"), 4) / 4, float(token[0] == "+"), float("(" in token),
        float(16 <= len(digits) <= 19 and luhn(digits)), float(16 <= len(digits) <= 19), float(len(quad) == 4 and all(p.isdigit() and p.isascii() and len(p) < 4 and int(p) < 256 for p in quad)), min(n, 40) / 40, float("=" in token),
        float(word and len(bare) <= 5), float(word and 6 <= len(bare) <= 7), float(word and len(bare) >= 8), float(inner and letters > len(digits)), float(len(digits) <= 4 and not letters), float(7 <= len(digits) <= 15 and not letters),
        float(cued and mixed), float(mixed), float(bool(_ISSUED.fullmatch(value))), float(cued),
    ]


@dataclass
class Graph:
    """Nodes of one or more documents with chain and skip edges; ``sort`` is each skip edge's."""

    spans: list[tuple[int, int, int]]
    x: np.ndarray
    given: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    sort: np.ndarray


def _skips(likes: dict[str, list[int]], given: list[int]) -> set[tuple[int, int]]:
    """Edges from each like to the next one, and to the first held one of each label, so that no like is far from what is known."""
    edges = set()
    for nodes in likes.values():
        edges.update(zip(nodes, nodes[1:], strict=False))
        first: dict[int, int] = {}
        for i in nodes:
            if given[i]:
                first.setdefault(given[i], i)
        edges.update((min(i, j), max(i, j)) for j in first.values() for i in nodes if not given[i])
    return edges


def _units(text: str, wanted: set[str], labelled: Callable[[int, int], int]) -> Iterator[tuple[int, int]]:
    """The tokens by place; tokens in a row outside base spans that make up a card's or a phone's digits come as one."""
    begun = {key[:n] for key in wanted if len(key) <= LONGEST_RUN and key.isdigit() for n in range(1, len(key))}
    if not begun:
        yield from (m.span() for m in _TOKEN.finditer(text))
        return
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    i = 0
    while i < len(tokens):
        a, b = tokens[i]
        joined, last, j = _PLAIN.sub("", text[a:b].lower()), i, i
        if joined in begun and not labelled(a, b):
            while joined in begun and j + 1 < len(tokens) and not labelled(*tokens[j + 1]):
                j += 1
                more = _PLAIN.sub("", text[slice(*tokens[j])].lower())
                joined += more
                if more and joined in wanted:
                    last = j
        yield a, tokens[last][1]
        i = last + 1


def graph(texts: list[str], bases: list[list[Span]]) -> Graph:
    """One graph of all the documents; ``given`` is the label of nodes inside base spans, else 0.  Edges stay within a document."""
    spans, x, given, chain, skip, sort = [], [], [], [], [], []
    for d, (text, base) in enumerate(zip(texts, bases, strict=True)):
        if "@" not in text and not _DIGIT.search(text):
            continue
        by_start = sorted((a, b, KINDS.index(k) + 1) for k, a, b in base)
        starts = [s[0] for s in by_start]
        reach = np.maximum.accumulate([s[1] for s in by_start]) if by_start else []
        keys = [(k, a, base_keys(text, (k, a, b))) for k, a, b in sorted(base, key=lambda s: s[1])]
        key_starts = [k[1] for k in keys]
        wanted = {key for _, _, own in keys for key in own}
        # What near and partial likes have in common with a base span, and the key that its held node goes by.
        short, groups = {}, {}
        for k, a, b in base:
            plain = _PLAIN.sub("", text[a : a + text[a:b].index("@") if k == "email" else b].lower())
            if k != "ip" and len(plain) in NEAR:
                for y in (plain, *_shorter(plain)):
                    short.setdefault(y, plain)
            if k in ("card", "phone"):
                for y in groups_of(k, text[a:b]):
                    groups.setdefault(y, plain)

        def labelled(a: int, b: int) -> int:
            i = bisect_right(starts, b - 1) - 1
            while i >= 0 and reach[i] > a:
                if by_start[i][1] > a:
                    return by_start[i][2]
                i -= 1
            return 0

        def add(a: int, b: int, label: int, own: Iterable[str], cued: bool = False) -> int:
            spans.append((d, a, b))
            x.append(token_features(text[a:b], cued))
            given.append(label)
            for key in own:
                likes.setdefault(key, []).append(len(spans) - 1)
            return len(spans) - 1

        likes: dict[str, list[int]] = {}
        alike: list[tuple[int, str, int]] = []
        before, cue = None, 0
        for a, b in _units(text, wanted, labelled):
            token = text[a:b]
            plain = _PLAIN.sub("", token.lower())
            part = token.rsplit("=", 1)[-1] if "=" in token else token.split("@")[0]
            own = ({plain, _PLAIN.sub("", part.lower())} & wanted) if wanted else set()
            # A cue holds for the next token that has a letter or digit, across signs and "is".
            cued, cue = cue > 0, (2 if _CUE.fullmatch(token.strip(_EDGE + "=")) else cue - 1 if plain and plain != "is" else cue)
            chained = bool(plain) and bool(_NODE.search(token))
            if not chained:
                before = None
                if not own:
                    continue
            elif cued:
                cue = 0
            label = labelled(a, b)
            near = [] if label or own or not base else [(SAME + NEAR_BY, short[y]) for y in (plain, *_shorter(plain)) if y in short][:1] if len(plain) in NEAR and short else []
            if not label and not own and plain in groups and "=" not in token:
                near.append((PART, groups[plain]))
            own.update(like_keys(token))
            # A base span hands its keys to the token it starts in; if that is held at another kind, it is a node itself.
            for kind, start, more in keys[bisect_left(key_starts, a) : bisect_left(key_starts, b)]:
                if KINDS.index(kind) + 1 == label:
                    own.update(more)
                else:
                    add(start, b, KINDS.index(kind) + 1, more)
            node = add(a, b, label, sorted(own), cued)
            alike += [(s, key, node) for s, key in near]
            if chained:
                if before is not None:
                    chain.append((before, node))
                before = node
        same = _skips(likes, given)
        edges = {e: SAME for e in same}
        for s, key, node in alike:
            held = next((i for i in likes.get(key, ()) if given[i]), None)
            if held is not None:
                edges.setdefault((min(held, node), max(held, node)), s)
        for e in sorted(edges):
            skip.append(e)
            sort.append(edges[e])
    pairs = lambda e: np.array(e, dtype=np.int64).reshape(-1, 2)
    return Graph(spans, np.array(x, dtype=float).reshape(-1, FEATURES), np.array(given, dtype=np.int64), pairs(chain), pairs(skip), np.array(sort, dtype=np.int64))


@dataclass
class Field:
    """Weights: ``node`` (features by labels), ``chain`` (label by next label), ``skip`` (sorts by labels) for equal labels."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def beliefs(self, g: Graph) -> np.ndarray:
        """Marginals of each node by loopy sum-product, nodes inside base spans held."""
        n = len(g.spans)
        unary = g.x @ self.node
        held = g.given > 0
        unary[held] = -50.0
        unary[held, g.given[held]] = 50.0
        edges = np.concatenate([g.chain, g.skip])
        if len(edges):
            kernels = np.exp(np.stack([self.chain, self.chain.T, *(np.diag(w) for w in self.skip)]))
            kind = np.concatenate([np.zeros(len(g.chain), dtype=np.int64), 2 + g.sort, np.ones(len(g.chain), dtype=np.int64), 2 + g.sort])
            source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
            # Held nodes hear nothing, or enough likes would outvote them; the way back of their messages is a row of zeros.
            heard = ~held[target]
            number = np.where(heard, np.cumsum(heard) - 1, -1)
            back = np.roll(number, len(edges))[heard]
            kind, source, target = kind[heard], source[heard], target[heard]
            message = np.zeros((len(source) + 1, LABELS))
            document = np.array([d for d, _, _ in g.spans], dtype=np.int64)
            # A label can travel through all nodes of a document; messages that still turn in circles after so many rounds are damped more, until they settle too.
            longest = np.bincount(document) + LEAST_ROUNDS
            moving, rounds = np.arange(len(source)), 0
            while len(moving):
                s, t = source[moving], target[moving]
                out = unary[s] - message[back[moving]]
                out = np.exp(out - out.max(axis=1, keepdims=True))
                new = np.empty_like(out)
                for k, kernel in enumerate(kernels):
                    at = kind[moving] == k
                    new[at] = np.log(out[at] @ kernel)
                new -= new.max(axis=1, keepdims=True)
                step = ((1 - DAMPING) * 0.5 ** (rounds // longest[document[s]]))[:, None] * (new - message[moving])
                message[moving] += step
                for k in range(LABELS):
                    unary[:, k] += np.bincount(t, step[:, k], n)
                # Only messages that still change, or leave a node that others changed, are passed on; so no document depends on those it is with.
                changed = np.abs(step).max(axis=1) >= SETTLED
                stirred = np.zeros(n, dtype=bool)
                stirred[t[changed]] = True
                awake = stirred[source]
                awake[moving[changed]] = True
                moving, rounds = np.flatnonzero(awake), rounds + 1
        p = np.exp(unary - unary.max(axis=1, keepdims=True)) if n else np.zeros((0, LABELS))
        return p / p.sum(axis=1, keepdims=True) if n else p


def practice(n: int = 800, seed: int = 7) -> tuple[list[str], list[dict[tuple[int, int], str]]]:
    """Made-up documents, and the places of what is personal in them outside base spans, each with its kind.

    What tells them from what is not: shapes (an address's local part that is a short word stands for the word elsewhere),
    neighbours (one group of a number's digits is any number, groups in a row are that number), likes, and words that
    announce a secret.
    """
    r = random.Random(seed)
    digits = lambda k: "".join(r.choices("0123456789", k=k))
    word = lambda a=2, b=8: "".join(r.choices("aeioulnrst", k=r.randint(a, b)))

    def card(ok: bool) -> str:
        head = "4" + digits(14)
        return head + next(c for c in "0123456789" if luhn(head + c) == ok)

    def slip(x: str) -> str:
        """``x`` with a digit or letter changed."""
        i = r.choice([i for i, c in enumerate(x) if c.isalnum()])
        return x[:i] + r.choice([c for c in ("0123456789" if x[i].isdigit() else "aeioulnrst") if c != x[i]]) + x[i + 1 :]

    Part = tuple[str, list[tuple[str, str | None]]]  # what is written before, and tokens with their kinds

    def mentions(kind: str) -> Iterator[Part]:
        if kind == "email":
            shape = r.randint(0, 4)
            local = (f"{word(3)}.{word(3)}{r.choice(['', digits(2)])}", f"{word(3)}_{word(3)}", f"{word(1, 6)}{digits(r.randint(1, 3))}", word(9, 12), word(1, 5))[shape]
            yield "", [(f"{local}@{word(3)}.{word(2)}.com" if r.random() < 0.7 else f"<{local}@{word(3)}.org>,", None)]
            for _ in range(r.randint(1, 2)):
                again = r.choice([local, local.title(), local, f"{local}@localhost"] if shape < 4 else [local])
                yield "", [(again, None if shape == 4 else "email")]
            if len(local) > 8 and r.random() < 0.5:
                yield "", [(slip(local), "email")]
        elif kind == "ip":
            ip = ".".join(str(r.randint(0, 255)) for _ in range(4))
            yield "", [(ip, None)]
            yield "", [(ip.replace(".", "-"), "ip")]
        elif kind == "card":
            c = card(True)
            four = [c[i : i + 4] for i in range(0, 16, 4)]
            if r.random() < 0.2:
                # No base span: the number stands in other groups only, and is known by its check digit.
                for _ in range(2):
                    yield "", [(r.choice([".", ".", "_"]).join(four), "card")]
                return
            yield "", [(r.choice(["", " ", "-"]).join(four), None)]
            for _ in range(r.randint(1, 3)):
                where = r.randint(0, 2)
                yield r.choice([
                    ("", [(r.choice([".", "_", "/"]).join(four), "card")]), ("", [(f"{four[0]}.{four[1]} {four[2]}.{four[3]}", "card")]), ("", [(slip(c), "card")]),
                    ("", [(x, "card") for x in four[where : where + 2]]), ("", [(x, "card") for x in four[:3]]), ("", [(r.choice(four), None)]), ("", [(r.choice(four), None)]), ("", [("-".join(four[where : where + 2]), "card")]),
                ])
        elif kind == "phone":
            area, mid, line = digits(3), digits(3), digits(4)
            yield "", [(r.choice([f"+1 ({area}) {mid}-{line}", f"+1-{area}-{mid}-{line}", f"+1{area}{mid}{line}"]), None)]
            for _ in range(r.randint(1, 3)):
                yield r.choice([
                    ("", [(f"{mid}-{line}", "phone")]), ("", [(f"{area}.{mid}.{line}", "phone")]), ("", [(f"{area}{mid}{line}", "phone")]), ("", [(f"({area}) {mid}-{line}", "phone")]), ("", [(slip(f"1-{area}-{mid}-{line}"), "phone")]),
                    ("", [(area, "phone"), (mid, "phone")]), ("", [(mid, "phone"), (area, "phone"), (line, "phone")]), ("", [(r.choice([area, mid, line]), None)]), ("", [(r.choice([area, mid, line]), None)]),
                ])
        else:
            value = r.choice(["0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"])
            value = "7a" + "".join(r.choices(value, k=r.randint(18, 40))) + "3f9"
            cue = r.choice(["token", "secret", "password", "api_key", "access-token", "passwd", "auth_token", "Secret", "TOKEN"])
            shown = r.choice([f'"{value}"', f"'{value}',", value])
            if r.random() < 0.7:
                yield r.choice([f"{cue} = ", f"{cue}: ", f"{cue} := ", f"{cue} is ", f"{cue} "]), [(shown, "secret")]
            else:
                yield "", [(f"{cue}={shown}", "secret")]
            if r.random() < 0.6:
                yield "", [(value, "secret")]

    def decoys() -> list[Part]:
        mixed = "9c" + "".join(r.choices("0123456789abcdef", k=r.choice([30, 38, 62]))) + "4b"
        some = [
            digits(r.randint(1, 7)), f"{r.randint(1, 9)}.{r.randint(0, 20)}.", card(False), ".".join(str(r.randint(256, 999)) for _ in range(4)), f"{word()}={digits(6)}{word()}", f"20{digits(2)}-{digits(2)}-{digits(2)}",
            f"{word()}-{word()}", f"{word()}.{word()}", f"{word().title()}{word().title()}", f"v{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", f"{digits(3)}-{digits(2)}", f"{r.randint(1, 9)},{digits(3)}", f"{digits(10)}", f"{word(6)}{digits(4)}",
        ]
        some.append(".".join(some[2][i : i + 4] for i in range(0, 16, 4)))
        out = [("", [(x, None)]) for x in r.sample(some, 4) for _ in range(r.randint(1, 2))]
        if r.random() < 0.5:
            out.append((r.choice(["commit ", "sum ", "", "id "]), [(mixed, None)]))
        if r.random() < 0.5:
            out.append((r.choice(["token ", "password is ", "secret = ", "api_key "]), [(r.choice([word(), digits(3), "none", f"{word()}-{word()}"]), None)]))
        if r.random() < 0.3:
            out.append(("", [(digits(3), None), (digits(3), None)]))
        return out

    texts, wanted = [], []
    for _ in range(n):
        parts = [m for _ in range(r.randint(1, 3)) for m in mentions(r.choice(FOUND))] + decoys()
        r.shuffle(parts)
        text, places = "", {}
        for lead, tokens in parts:
            text += " ".join(word() for _ in range(r.randint(1, 5))) + " " + lead
            for token, kind in tokens:
                if kind:
                    a, b = trimmed(token, kind)
                    places[len(text) + a, len(text) + b] = kind
                text += token + " "
        texts.append(text)
        wanted.append(places)
    return texts, wanted


def trimmed(token: str, kind: str) -> tuple[int, int]:
    """Where the span of a token lies in it: without marks around, and for a secret behind the equals sign."""
    a, b = 0, len(token)
    if kind == "secret" and 0 < (at := token.find("=")) < len(token.rstrip("=" + _EDGE)) - 1:
        a = at + 1
    opening, closing = "([{<\"'.,;:=", ")]}>\"'.,;:!?"
    part = token[a:]
    return a + len(part) - len(part.lstrip(opening)), b - len(part) + len(part.rstrip(closing))


def _truth(g: Graph, texts: list[str], wanted: list[dict[tuple[int, int], str]]) -> np.ndarray:
    """The label of every node, those of practice texts by place."""
    truth = g.given.copy()
    for i, (d, a, b) in enumerate(g.spans):
        if not truth[i]:
            for k, kind in enumerate(FOUND):
                x, y = trimmed(texts[d][a:b], kind)
                # A unit of some tokens has the kind of what it is made of.
                if any(q == kind and a + x <= u and v <= a + y for (u, v), q in wanted[d].items()):
                    truth[i] = k + 1
    return truth


@cache
def trained() -> Field:
    """The field fitted to :func:`practice` by gradient steps on a composite likelihood.

    Each chain edge's two labels are taken together, given the true labels of all others, and each node without chain edge
    alone; taken one by one, neighbours that need each other would each be learnt as if the other were known.
    """
    texts, wanted = practice()
    g = graph(texts, [base_spans(t) for t in texts])
    truth = _truth(g, texts, wanted)
    n, one = len(truth), np.eye(LABELS)
    y = one[truth]
    f = Field(np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((SORTS, LABELS)))
    # How many likes of each label a node has, by sort.
    alike = np.zeros((SORTS, n, LABELS))
    for i, j in ((0, 1), (1, 0)):
        np.add.at(alike, (g.sort, g.skip[:, i]), y[g.skip[:, j]])
    a, b = g.chain[:, 0], g.chain[:, 1]
    before, after = np.full(n, -1), np.full(n, -1)
    before[b], after[a] = a, b
    single = np.flatnonzero((before < 0) & (after < 0) & (g.given == 0))
    held = g.given > 0
    outer_a, outer_b = before[a], after[b]
    has_a, has_b = np.flatnonzero(outer_a >= 0), np.flatnonzero(outer_b >= 0)
    steps, velocity = 1200, [np.zeros_like(w) for w in (f.node, f.chain, f.skip)]
    count = len(single) + len(a)
    for step in range(steps):
        own = g.x @ f.node + np.einsum("snk,sk->nk", alike, f.skip)
        own[held] = np.where(y[held] > 0, 0.0, -1e9)
        left, right = own[a], own[b]
        left[has_a] += f.chain[truth[outer_a[has_a]]]
        right[has_b] += f.chain[:, truth[outer_b[has_b]]].T
        p = left[:, :, None] + right[:, None, :] + f.chain
        p = np.exp(p - p.max(axis=(1, 2), keepdims=True))
        p /= p.sum(axis=(1, 2), keepdims=True)
        off_a, off_b = y[a] - p.sum(axis=2), y[b] - p.sum(axis=1)
        chain = -p.sum(axis=0)
        np.add.at(chain, (truth[a], truth[b]), 1.0)
        np.add.at(chain, truth[outer_a[has_a]], off_a[has_a])
        np.add.at(chain.T, truth[outer_b[has_b]], off_b[has_b])
        alone = np.exp(own[single] - own[single].max(axis=1, keepdims=True))
        off = np.zeros((n, LABELS))
        off[single] = y[single] - alone / alone.sum(axis=1, keepdims=True)
        np.add.at(off, a, off_a)
        np.add.at(off, b, off_b)
        off[held] = 0
        slopes = (g.x.T @ off / count - 1e-4 * f.node, chain / count - 1e-4 * f.chain, np.einsum("snk,nk->sk", alike, off) / count - 1e-4 * f.skip)
        rate = 1.0 if step < steps * 2 // 3 else 0.2
        for w, v, slope in zip((f.node, f.chain, f.skip), velocity, slopes, strict=True):
            v *= 0.9
            v += rate * slope
            w += v
    return f


def spans_of(texts: list[str], model: Field) -> list[tuple[list[Span], list[Span]]]:
    """The base spans of each text, and the further ones that the field finds, either by kind and start."""
    bases = [base_spans(t) for t in texts]
    more: list[list[Span]] = [[] for _ in texts]
    g = graph(texts, bases)
    if (g.given == 0).any():
        p = model.beliefs(g)
        label = np.where(p.max(axis=1) >= BELIEF, p.argmax(axis=1), 0)
        found = set(np.flatnonzero(label == SECRET).tolist())
        for a, b in g.skip.tolist():
            if label[a] == label[b] > 0:
                found |= {a, b}
        for i in sorted(found):
            if not g.given[i]:
                d, a, b = g.spans[i]
                kind = FOUND[label[i] - 1]
                x, y = trimmed(texts[d][a:b], kind)
                if x < y:
                    more[d].append((kind, a + x, a + y))
    order = lambda s: (FOUND.index(s[0]), s[1])
    return [(sorted(b, key=order), sorted(m, key=order)) for b, m in zip(bases, more, strict=True)]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _listed(spans: list[list[Span]]) -> pa.Array:
    return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in spans], _SPANS)


def _found(batches: Iterator[pa.RecordBatch], model: Field) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        both = spans_of([t or "" for t in batch.column(1).to_pylist()], model)
        yield pa.RecordBatch.from_arrays([batch.column(0), _listed([b for b, _ in both]), _listed([m for _, m in both])], ["key", "base", "further"])


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, base, further``: the spans (kind, start, end; code points, end exclusive) of each whole text, by kind and start."""
    small_batches(docs.sparkSession)
    model = trained()
    kind = docs.schema[key].dataType.simpleString()
    spans = "array<struct<kind: string, start: bigint, end: bigint>>"
    return docs.select(F.col(key).alias(key), F.col(text).alias("__text")).mapInArrow(lambda it: _found(it, model), f"key {kind}, base {spans}, further {spans}").withColumnRenamed("key", key)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contract's columns of :func:`find`'s rows."""
    said = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    place = F.create_map(*(F.lit(v) for i, k in enumerate(FOUND) for v in (k, i)))
    every = F.array_sort(F.transform(F.concat("base", "further"), lambda s: F.struct(place[s["kind"]].alias("at"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    of_kind = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in KINDS]
    return found.select(key, *counts, F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(every).alias("spans"), F.size("further").cast("long").alias("n_further"), (F.size("base") + F.size("further")).cast("long").alias("n_spans"))


def masked_text(text: str, spans: list[Span]) -> str:
    """The text with each stretch that spans cover replaced by the kind of the first, in brackets."""
    out, end = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{k.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def _masked(batches: Iterator[pa.RecordBatch], model: Field, column: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, column):
        texts = batch.column(column).to_pylist()
        both = spans_of([t or "" for t in texts], model)
        if any(b or m for b, m in both):
            new = [masked_text(t, b + m) if b or m else t for t, (b, m) in zip(texts, both, strict=True)]
            batch = batch.set_column(column, batch.schema.field(column), pa.array(new, batch.schema.field(column).type))
        yield batch


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents, all columns, with every span replaced by its kind in brackets."""
    small_batches(docs.sparkSession)
    model, column = trained(), docs.columns.index(text)
    return map_rows(docs, lambda it: _masked(it, model, column))
