"""Secret scans: base patterns, and an assignment-aware lexer over source and configuration syntax.

The lexer reads name-value pairs (name = "literal", "name": 'literal', export NAME=value,
name := a + "b", { name => value }, <name>value</name>, key="name" value="value", literals in triple
quotes), in comments as elsewhere, keeps the literals that a name was given, follows names on the
right-hand side to them (constant propagation, in text order), and scores each literal by the
sensitivity of the name it reaches and by its own look. Spans of base patterns stay as they are.

All scans are linear in the text: a name is read backwards from its sign; a value of more than
MOST_TEXT characters is carried on by what its score needs in place of its text; and a value names those it is made
of, so that its literals are walked once, however many names they reach.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped, text_strings

#: The base patterns.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the maximal runs of 32 and more
KINDS = ("assign", "access", "hex", "lexed")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16

#: Parts of a name that make it sensitive, with their weights; two parts in a row may form one.
SENSITIVE = {"password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 3, "apikey": 3, "accesskey": 3, "privatekey": 3, "secretkey": 3, "encryptionkey": 3, "signingkey": 3, "clientsecret": 3, "credential": 3, "credentials": 3, "bearer": 2, "auth": 2, "authorization": 2, "pat": 1, "key": 1, "salt": 1, "pin": 1}
#: Name parts that say the value isn't one.
HARMLESS = {"length", "len", "count", "name", "path", "file", "url", "uri", "type", "id", "expiry", "ttl", "size", "field", "label", "prefix", "header", "hint", "policy", "regex", "pattern", "limit", "max", "min"}
#: Whole values, or starts of values, that stand in for a real one.
PLACEHOLDER = re.compile(r"(?:change[-_]?me|example|placeholder|your[-_]|dummy|test|todo|none$|null$|true$|false$|undefined$|x{4,}|\*{3,}|<|\$\{|\{\{|%\()", re.I)
LEAST_LENGTH, LEAST_SCORE = 8, 5.0

#: Characters of a value that is carried on as text. A longer one is carried as its length, its first HEAD characters, and
#: how often each of CLASSES classes of characters stands in it (by code point, so that ASCII has a class a character).
MOST_TEXT, HEAD, CLASSES = 1024, 64, 256

_NAME_CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-"
_QUOTED_NAME = re.compile(r"[A-Za-z_][\w.\- ]*", re.A)
_NAME_START = re.compile(r"[A-Za-z_$]")
_SIGN = re.compile(r"(?::=|=>|(?<![=!<>:+\-*/%&|^])=(?![=>])|:(?![:=/]))")
_SPACE = re.compile(r"[ \t]*")
_QUOTED = re.compile(r'''"""((?:[^"\\]|\\.|"(?!""))+)"""|"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`((?:[^`\\\n]|\\.)*)`''')
_IDENT = re.compile(r"[A-Za-z_$][\w.]*", re.A)
_BARE = re.compile(r"""[^\s"'`,;)}\]=<]+(?:=+(?![^\s"'`,;)}\]<]))?""")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.\-]*)(?:\s[^<>\n]*)?>([^<>\n]+)</", re.A)
_ATTRIBUTES = re.compile(r"""\b(?:key|name)[ \t]*=[ \t]*(["'])([A-Za-z_][\w.\-]*)\1[ \t]+value[ \t]*=[ \t]*(["'])([^"'\n]+)\3""", re.A)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns; a match of too short a value is used up, not kept."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_LEAST]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def name_weight(name: str) -> int:
    """How sensitive a target name is: its heaviest part, 0 with a part that says otherwise last."""
    parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]
    if not parts or parts[-1] in HARMLESS:
        return 0
    return max([SENSITIVE.get(p, 0) for p in parts] + [SENSITIVE.get(a + b, 0) for a, b in zip(parts, parts[1:])])


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def kinds_of(value: str) -> tuple[bool, ...]:
    """Whether small letters, capitals, digits and others stand in a value."""
    return tuple(bool(re.search(k, value)) for k in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))


def literal_score(value: str) -> float:
    """0 for what can't be a secret, else up to 4: bits a character, and kinds of characters."""
    if len(value) < LEAST_LENGTH or PLACEHOLDER.match(value) or any(c.isspace() for c in value):
        return 0.0
    return min(entropy(value), 3.0) + (sum(kinds_of(value)) - 1) / 3


class Value:
    """What a name holds: `text` while it is short, else (text None) its length, head, counts by class, kinds and whether
    a blank stands in it; spans of its own literals, and the values it is made of besides."""

    __slots__ = ("text", "size", "head", "counts", "kinds", "blank", "spans", "made_of", "told")

    def __init__(self, parts: list, spans: list):
        """parts: texts and values, in order; spans: where the literals among them stand."""
        self.spans, self.made_of, self.told = spans, [p for p in parts if isinstance(p, Value)], False
        flat = [p.text if isinstance(p, Value) and p.text is not None else p for p in parts]
        self.size = sum(len(p) if isinstance(p, str) else p.size for p in flat)
        if self.size <= MOST_TEXT:
            self.text = "".join(flat)
            return
        self.text, self.counts = None, [0.0] * CLASSES
        self.head = "".join(p[:HEAD] if isinstance(p, str) else p.head for p in flat[:HEAD] if p)[:HEAD]
        for p in flat:
            for c, n in Counter(p).items() if isinstance(p, str) else enumerate(p.counts):
                self.counts[ord(c) % CLASSES if isinstance(p, str) else c] += n
        self.kinds = tuple(map(any, zip(*[kinds_of(p) if isinstance(p, str) else p.kinds for p in flat])))
        self.blank = any(any(c.isspace() for c in p) if isinstance(p, str) else p.blank for p in flat)
        if self.size > 1e15:  # doubled again and again: shares stay as they are
            self.counts = [n * (1e15 / self.size) for n in self.counts]
            self.size = 1e15

    def score(self) -> float:
        """literal_score of the value; classes stand for characters in a long one."""
        if self.text is not None:
            return literal_score(self.text)
        if self.blank or PLACEHOLDER.match(self.head):
            return 0.0
        shares = [n / self.size for n in self.counts if n]
        return min(-sum(x * math.log2(x) for x in shares), 3.0) + (sum(self.kinds) - 1) / 3

    def untold(self):
        """Spans of all literals that reach this value and that no earlier call gave."""
        todo = [self]
        while todo:
            v = todo.pop()
            if not v.told:
                v.told = True
                yield from v.spans
                todo += v.made_of


def _run_before(text: str, at: int, chars: str) -> int:
    """Start of the run of chars that ends at `at`."""
    width = 64
    while True:
        piece = text[max(0, at - width) : at]
        kept = len(piece.rstrip(chars))
        if kept or at <= width:
            return at - len(piece) + kept
        width *= 4


def name_before(text: str, at: int) -> str | None:
    """The name that ends before a sign at `at`, in quotes or not, with a bracket or blanks between at most."""
    end = _run_before(text, at, " \t")
    if text[end - 1 : end] == "]":
        end = _run_before(text, end - 1, " \t")
    if text[end - 1 : end] in ("'", '"'):
        start = text.rfind(text[end - 1], 0, end - 1)
        name = text[start + 1 : end - 1]
        return name if start >= 0 and _QUOTED_NAME.fullmatch(name) else None
    start = _run_before(text, end, _NAME_CHARS)
    start -= text[start - 1 : start] == "$"
    m = _NAME_START.search(text, start, end)
    return text[m.start() : end] if m else None


def pairs(text: str):
    """(name, value, is_literal) of each assignment, in text order: the value is all literals of the
    right-hand side joined; names on the right are followed to theirs."""
    known: dict[str, Value] = {}
    for sign in _SIGN.finditer(text):
        if not (name := name_before(text, sign.start())):
            continue
        i, parts, spans, literal = sign.end(), [], [], False
        reached = False  # a literal that is not empty, or a name that holds one
        while True:
            i = _SPACE.match(text, i).end()
            if q := _QUOTED.match(text, i):
                g, literal = q.lastindex, True
                parts.append(q[g])
                if q[g]:
                    spans.append(q.span(g))
            elif (q := _IDENT.match(text, i)) and q[0] in known:
                parts.append(known[q[0]])
                reached = True
            elif not (spans or reached) and (q := _BARE.match(text, i)):
                parts.append(q[0])
                spans.append(q.span())
            else:
                break
            i = _SPACE.match(text, q.end()).end()
            if text[i : i + 1] not in ("+", "."):
                break
            i += 1
        if spans or reached:
            known[name] = value = Value(parts, spans)
            yield name, value, literal


def markup_pairs(text: str):
    """The same of elements and of key and value attributes."""
    for pattern, name, value in ((_ELEMENT, 1, 2), (_ATTRIBUTES, 2, 4)):
        for m in pattern.finditer(text):
            yield m[name], Value([m[value].strip()], [m.span(value)]), True


def lexed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of literals that reach a sensitive name and score enough together."""
    found = set()
    for name, value, literal in itertools.chain(pairs(text), markup_pairs(text) if "<" in text else ()):
        if (w := name_weight(name)) and (s := value.score()) and w + s + (0.5 if literal else 0) >= LEAST_SCORE:
            found.update((a, b, 3) for a, b in value.untold() if b > a)
    return sorted(found)


def scan(text: str) -> tuple[list, list]:
    """Base spans, and all spans in order; the lexer adds none that lies in a base one."""
    base = base_spans(text)
    if "=" not in text and ":" not in text and "</" not in text:
        return base, base
    more, k, reach = [], 0, -1  # reach: the furthest end of base spans that start no later
    for x in lexed_spans(text):
        while k < len(base) and base[k][0] <= x[0]:
            reach = max(reach, base[k][1])
            k += 1
        if x[1] > reach:
            more.append(x)
    return base, sorted(base + more, key=lambda x: (x[0], x[2], x[1]))


def said(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans, mask: str = "[secret]") -> str:
    """Text with its spans, joined where they overlap, replaced."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join(out) + text[at:]


def find_secrets_in(docs: DataFrame, *, text_col="text") -> DataFrame:
    """The other columns of docs, and n_assign, n_access, n_hex, base_sha256, spans and redacted (the masked text).

    An empty table gives no rows. A null text is empty: no spans, the hash of the empty string, and null redacted. No shuffle; rows are
    independent, so repeated ids are documents of their own. Texts are taken whole. Columns of docs that are
    named like one of the results give way to it."""
    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"]
    others = [c for c in docs.columns if c != text_col and c not in names]
    source = docs.select(docs[text_col].cast("string").alias("_inkwell_text"), *[docs[c] for c in others])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[1:]] + ["n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string"])

    def run(batches):
        for b in batches:
            rows = []
            for text in text_strings(b.column(0)):
                base, spans = scan(text or "")
                n = Counter(k for *_, k in base)
                rows.append((n[0], n[1], n[2], hashlib.sha256(said(base).encode()).hexdigest(), said(spans), redact(text, spans) if text is not None else None))
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *[pa.array(c, pa.int64()) for c in cols[:3]], *[pa.array(c, pa.string()) for c in cols[3:]]], [*others, *names])

    return source.transform(mapped, run, schema)


def find_secrets(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """Per document: its id, n_assign, n_access, n_hex, base_sha256, spans and redacted, as find_secrets_in gives them."""
    return find_secrets_in(docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col]), text_col=text_col)


def op6(spark, sf_dir):
    from .common import table

    return find_secrets(table(spark, sf_dir, "documents")).drop("redacted")
