"""Text functions as column expressions: cleaning, tokens, estimates and predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
LIGATURES = (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"))
TOKEN = r"[一-鿿]+|[a-zA-Z0-9_.\-/^²³₀-₉]+|[+\-*/=()\[\]{}]"
CJK = "[一-鿿]"
QUESTION_WORDS = ("什么", "如何", "怎么", "是否", "为何", "为什么", "哪些", "能否")
FUNCTION_CHARS = "的是吗呢吧么"
ENTITY_ATTRIBUTES = ("学号", "姓名", "电话", "手机号", "邮箱", "班级", "专业", "学院", "地址", "身份证")
ASKING_PREFIX = "^(?:请问|告诉我|查询|查一下|想知道)"
QA_MARKERS = ("问题：", "答案：", "Q：", "A：", "问：", "答：")
BOILERPLATE = (
    r"^\s*第?\s*(\d{1,4})\s*页\s*(?:[/of共]\s*\d*\s*页?)?\s*[，,。.．]?\s*$",
    r"(?i)^\s*page\s+\d{1,4}\s+of\s+\d{1,4}\s*$",
    r"(?i)^\s*(机密|保密|内部资料|内部文件|草稿|草案|版权所有|版权声明|Copyright|Confidential|Draft|All rights reserved|未经.*许可.*不得|仅供.*使用|请勿.*外传)\s*[。.]?\s*$",
    r"^\s*[-*_=~]{3,}\s*$",
    r"^\s*\d{1,4}\s*$",
)
BOILERPLATE_LENGTH = 60
SCOPE_PATTERN = "全局变量|局部变量|包外|其他包|导入|导出|访问"
SCOPE_SYNONYMS = ("可见性", "公有", "私有", "大写", "小写", "包内", "包外")
NAME_SYNONYMS = ("命名规则", "名称", "类型", "变量")
LANGUAGE_WORDS = ("变量", "标识符", "包", "可见性")
INTENT = "可见性"
QUOTES = (("```", "```"), ('"', '"'), ("'", "'"), ("「", "」"), ("“", "”"))
NO_ITEM, ITEM_MARK, ITEM_LENGTH, ITEMS = "无", r"^\s*(?:[-*]\s*|\d+[.)]\s*|子问题\d*\s*[:：]\s*)", 60, 3
TOPIC_LENGTH, NO_TOPIC = 80, "未命名资料"
# Addresses that are no public hosts, by pattern (private, loopback, link-local, reserved, multicast).
LOCAL_HOST = r"(?i)^(?:localhost|.*\.localhost|(?:0|10|127|2(?:2[4-9]|[345]\d))(?:\.\d{1,3}){3}|169\.254(?:\.\d{1,3}){2}|172\.(?:1[6-9]|2\d|3[01])(?:\.\d{1,3}){2}|192\.168(?:\.\d{1,3}){2}|\[(?:::1?|f[cdef][0-9a-f]{2}:.*|::ffff:.*)\])$"
FORMULA = r"(?:\\[a-zA-Z]+|[_^{}=+*/]|\d)"

_SPACE = r"[ \t\n\r\x0b\x0c]"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, rf"^{_SPACE}+|{_SPACE}+\z", "")


def clean_text(c: Column, keep_spaces: bool = False) -> Column:
    """Ligatures apart, control characters out; unless spaces are kept, hyphens at line ends joined and runs of spaces one."""
    for a, b in LIGATURES:
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "")
    if keep_spaces:
        return c
    c = F.regexp_replace(c, r"([A-Za-z])-([ \t]*)\n([A-Za-z])", "$1$3")
    return F.regexp_replace(F.replace(c, F.lit("　"), F.lit(" ")), r"[ \t]+", " ")


def is_boilerplate(line: Column) -> Column:
    """A page number, notice or divider of at most 60 characters."""
    s = strip(line)
    hit = F.lit(False)
    for p in BOILERPLATE:
        hit = hit | line.rlike(p)
    return (s != "") & (F.length(s) <= BOILERPLATE_LENGTH) & hit


def tokenize(c: Column) -> Column:
    """Runs of Latin letters, digits and signs whole, runs of ideographs as pairs (single ones whole), case kept."""
    pairs = lambda seg: F.transform(F.sequence(F.lit(1), F.length(seg) - 1), lambda i: F.substring(seg, i, F.lit(2)))
    c = F.coalesce(c, F.lit(""))
    parts = F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))
    paired = F.flatten(F.transform(parts, lambda s: F.when(s.rlike(f"^{CJK}{{2,}}$"), pairs(s)).otherwise(F.array(s))))
    return F.when(c.rlike(CJK), paired).otherwise(parts)


def token_count(c: Column) -> Column:
    """Size of tokenize(c); without ideographs that is the number of matches."""
    c = F.coalesce(c, F.lit(""))
    return F.when(c.rlike(CJK), F.size(tokenize(c))).otherwise(F.regexp_count(c, F.lit(TOKEN))).cast("long")


def is_meaningful(token: Column) -> Column:
    """Neither a question word nor a function character in it."""
    return (token != "") & ~token.rlike("|".join(QUESTION_WORDS)) & ~token.rlike(f"[{FUNCTION_CHARS}]")


def query_tokens(c: Column) -> Column:
    return F.filter(tokenize(c), is_meaningful)


def query_terms(c: Column) -> Column:
    """Distinct meaningful tokens of two characters or more."""
    return F.array_distinct(F.filter(tokenize(c), lambda t: (F.length(t) >= 2) & is_meaningful(t)))


def query_phrases(c: Column) -> Column:
    """Distinct three-character windows of ideographs that neither begin nor end in a function character."""
    windows = lambda seg: F.transform(F.sequence(F.lit(1), F.length(seg) - 2), lambda i: F.substring(seg, i, F.lit(3)))
    found = F.flatten(F.transform(F.regexp_extract_all(c, F.lit(f"{CJK}{{3,}}"), F.lit(0)), windows))
    good = lambda p: ~p.rlike("|".join(QUESTION_WORDS)) & ~p.rlike(f"^[{FUNCTION_CHARS}]|[{FUNCTION_CHARS}]$")
    return F.array_distinct(F.filter(found, good))


def query_anchors(c: Column) -> Column:
    """Distinct subjects of which an attribute is asked."""
    found = F.regexp_extract_all(c, F.lit(rf"({CJK}{{2,12}})\s*的\s*(?:{'|'.join(ENTITY_ATTRIBUTES)})"), F.lit(1))
    bare = F.transform(found, lambda x: F.regexp_replace(x, ASKING_PREFIX, ""))
    return F.array_distinct(F.filter(bare, lambda x: F.length(x) >= 2))


def hits(terms: Column, text: Column) -> Column:
    """How many of the terms occur in the text."""
    return F.size(F.filter(terms, lambda t: F.instr(text, t) > 0))


def compact(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")


def expand_question(c: Column) -> Column:
    """The question with synonyms for recall, by fixed rules; unchanged if none holds."""
    has = lambda *words: c.rlike("|".join(words))
    low = F.lower(c)
    go = low.contains("go") | has(*LANGUAGE_WORDS)
    scope = go & low.rlike(SCOPE_PATTERN)
    none = F.array().cast("array<string>")
    words = lambda *w: F.array(*map(F.lit, w))
    terms = F.array_distinct(F.concat(F.when(scope, words(*SCOPE_SYNONYMS)).otherwise(none), F.when(has("标识符"), words(*NAME_SYNONYMS)).otherwise(none)))
    return F.when(F.size(terms) > 0, F.concat_ws(" ", c, F.array_join(terms, " "))).otherwise(c)


#: Letters whose upper case is several letters, and the one letter that stands for each where there is one.
_SPREAD = [c for c in map(chr, range(0x10000)) if len(c.upper()) > 1]
_ONE = "".join("ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in _SPREAD)


def upper_each(c: Column) -> Column:
    """Upper case letter by letter, as SQL engines have it: ß becomes ẞ and not SS, a ligature stays."""
    spread = "".join(_SPREAD)
    pieces = F.regexp_extract_all(c, F.lit(f"[{spread}]+|[^{spread}]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(f"^[{spread}]"), F.translate(p, spread, _ONE)).otherwise(F.upper(p))), "")


def estimate_tokens(c: Column) -> Column:
    """Ideographs, and a quarter of the other characters; 1 at least, 0 for an empty text."""
    cjk = F.length(F.regexp_replace(c, "[^一-鿿]", ""))
    n = cjk + F.floor((F.length(c) - cjk) / 4)
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), n)).cast("long")


def plausible_formula(c: Column) -> Column:
    f = strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return (f != "") & (F.length(f) <= 1600) & (F.regexp_count(f, F.lit(r"\\quad")) <= 8) & (F.regexp_count(f, F.lit("本题")) <= 4) & f.rlike(FORMULA)


def sentence_parts(c: Column, ends: str) -> Column:
    return F.filter(F.transform(F.split(c, ends), strip), lambda p: p != "")


def split_sentences(c: Column, ends: str = r"[。！？.!?\n]+", marks=("。", "！", "？", ".", "!", "?")) -> Column:
    """Trimmed sentences, each with the first mark that follows it somewhere in the text."""

    def ended(p):
        out = p
        for m in reversed(marks):
            out = F.when(F.instr(c, F.concat(p, F.lit(m))) > 0, F.concat(p, F.lit(m))).otherwise(out)
        return out

    return F.transform(sentence_parts(c, ends), ended)


def marked_sentences(parts: Column, found: Column) -> Column:
    """Sentences, each with the first of the marks found in the text that isn't among its last two characters."""
    return F.transform(parts, lambda p: F.concat(p, F.coalesce(F.get(F.filter(found, lambda m: ~F.right(p, F.lit(2)).contains(m)), 0), F.lit(""))))


def unquoted(c: Column) -> Column:
    """A trimmed text without the first pair of QUOTES that encloses it; only one pair is taken off."""
    s = strip(c)
    out = s
    for a, b in reversed(QUOTES):
        inner = strip(F.substring(s, len(a) + 1, F.greatest(F.length(s) - len(a) - len(b), F.lit(0))))
        out = F.when(s.startswith(a) & s.endswith(b), inner).otherwise(out)
    return out


def rewritten(raw: Column, question: Column) -> Column:
    """A model's rewrite of a question, or the question where it is null, empty or over three times as long."""
    r = unquoted(F.coalesce(raw, F.lit("")))
    return F.when((r == "") | (F.length(r) > 3 * F.length(question)), question).otherwise(r)


def listed_items(raw: Column, question: Column) -> Column:
    """The first ITEMS distinct items of a list that a model wrote a line each, without bullets and numbers, neither blank,
    NO_ITEM, the question itself nor over ITEM_LENGTH characters."""
    items = F.transform(F.split(F.coalesce(raw, F.lit("")), r"\r\n|[\n\r\x0b\x0c]"), lambda x: strip(F.regexp_replace(strip(x), ITEM_MARK, "")))
    good = lambda x: (x != "") & (x != NO_ITEM) & ~x.eqNullSafe(question) & (F.length(x) <= ITEM_LENGTH)
    return F.slice(F.array_distinct(F.filter(items, good)), 1, ITEMS)


def lenient_object(raw: Column) -> Column:
    """The JSON object in a model's answer, as text: the whole answer, else from its first brace to its last; null if
    neither is an object."""
    s = strip(raw)
    # within brackets, since the parser ignores what follows a whole value
    alone = lambda c: F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    valid = lambda c: F.coalesce(alone(c).isNotNull() & F.try_variant_get(alone(c), "$[1]", "variant").isNull(), F.lit(False))
    is_object = lambda c: valid(c) & F.schema_of_variant(alone(c)).startswith("ARRAY<OBJECT")
    part = F.nullif(F.regexp_extract(s, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.when(valid(s), F.when(is_object(s), s)).when(is_object(part), part)


def verdict(raw: Column, name: str = "vague") -> Column:
    """The truth value of a member anywhere in a model's answer, in either case; null if there is none."""
    v = F.lower(F.regexp_extract(raw, rf'(?i)"{name}"\s*:\s*(true|false)', 1))
    return F.when(v != "", v == "true")


def file_stem(path: Column) -> Column:
    """The last part of a path without its last extension; a name that is only an extension stays."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def topic(value: Column) -> Column:
    """A heading or line as a topic: without number signs before it and brackets, cut to TOPIC_LENGTH."""
    bare = F.regexp_replace(strip(F.regexp_replace(value, r"^#+\s*", "")), r"[\[\]【】]", "")
    cut = strip(F.substring(bare, 1, TOPIC_LENGTH))
    return F.when(cut == "", NO_TOPIC).otherwise(cut)


def url_fault(url: Column) -> Column:
    """Why a page may not be fetched: its scheme, or a host that is written as a local address; null if it may be.
    Names are not resolved."""
    parts = lambda i: F.regexp_extract(strip(F.coalesce(url, F.lit(""))), r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", i)
    return F.when(~F.lower(parts(1)).isin("http", "https") | (parts(2) == ""), "scheme").when(parts(2).rlike(LOCAL_HOST), "local")


def url_file(url: Column) -> Column:
    """The name of a fetched page: the stem of its path, else the first label of its host; other characters than letters,
    digits, - and _ are _, 100 at most."""
    path = F.regexp_replace(F.regexp_extract(strip(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#;]*)", 1), "/+$", "")
    host = F.regexp_extract(strip(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#.]*)", 1)
    name = F.coalesce(F.nullif(file_stem(path), F.lit("")), F.nullif(host, F.lit("")), F.lit("web_article"))
    return F.concat(F.substring(F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_"), 1, 100), F.lit(".html"))
