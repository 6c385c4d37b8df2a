"""Clean-up of scraped strings: the source's two entity tables, and helpers around delimiters and addresses."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values, in the order in which they are replaced; euro and copy are swapped there as here.
COMMON = """
&#x27; ' &#33; ! &#36; $ &#37; % &#38; & &#39; ' &#033; ! &#036; $ &#037; % &#038; & &#039; ' &#8211; - &gt; > &lt; <
&amp; & &ldquo; " &rdquo; " &quot; " &lsquo; ' &rsquo; ' &nbsp; SPACE &cent; ¢ &pound; £ &yen; ¥ &euro; © &copy; € &reg; ®
［ [ ］ ] （ ( ） ) &frac12; ½ &deg; ° &sup2; ²
""".split()
LETTERS = """
&#171; « &#176; ° &Agrave; À &#192; À &Aacute; Á &#193; Á &Acirc; Â &#194; Â &Atilde; Ã &ccedil; ç &Egrave; È &Eacute; É
&Ecirc; Ê &#202; Ê &Etilde; Ẽ &Igrave; Ì &Iacute; Í &Itilde; Ĩ &ETH; Đ &Ograve; Ò &Oacute; Ó &Ocirc; Ô &#212; Ô &Otilde; Õ
&Ugrave; Ù &Uacute; Ú &Yacute; Ý &#221; Ý &agrave; à &#224; à &aacute; á &#225; á &acirc; â &#226; â &atilde; ã &#227; ã
&#231; ç &egrave; è &#232; è &eacute; é &#233; é &etilde; ẽ &ecirc; ê &#234; ê &igrave; ì &#236; ì &iacute; í &#237; í
&itilde; ĩ &#238; î &eth; đ &ograve; ò &#242; ò &oacute; ó &#243; ó &ocirc; ô &#244; ô &otilde; õ &#245; õ &ugrave; ù
&#249; ù &uacute; ú &#250; ú &yacute; ý &#253; ý &#8217; ' &#8220; " &#8221; " &#8230; ... &Auml; Ä &auml; ä &Ouml; Ö
&ouml; ö &Uuml; Ü &uuml; ü &szlig; ß &mu; μ &#956; μ &raquo; » &laquo; « &#8216; ‘ &ndash; - &gamma; γ
""".split()
#: Series status codes and the word that tells each, tried in this order.
STATUSES = (("1", "ongoing"), ("0", "complete"), ("2", "hiatus"), ("3", "cancel"))
BLANKS = "".join(map(chr, range(33)))


def _pairs(table: list[str]) -> list[tuple[str, str]]:
    return [(a, " " if b == "SPACE" else b) for a, b in zip(table[::2], table[1::2], strict=True)]


_COMMON, _LETTERS = [("\n", "\\n"), ("\r", "\\r"), *_pairs(COMMON)], _pairs(LETTERS)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _passes(pairs: list[tuple[str, str]]) -> list[tuple[str, re.Pattern, str]]:
    """Whole entities first, then those that lost their semicolon."""
    bare = [(a[:-1], b) for a, b in pairs if len(a) > 1 and a.endswith(";")]
    return [(a, re.compile(re.escape(a), re.I | re.A), b) for a, b in [*pairs, *bare]]


_COMMON_PASSES, _LETTERS_PASSES = _passes(_COMMON), _passes(_LETTERS)


def _decoded(text: str, passes: list[tuple[str, re.Pattern, str]], any_case: bool) -> str:
    """Entities in the order of their passes; a name that is there goes in any case of letters."""
    seen = text.translate(_LOWER) if any_case else text
    for name, pattern, value in passes:
        if name in seen:
            text = pattern.sub(lambda _, v=value: v, text)
            seen = text.translate(_LOWER) if any_case else text
    return text


def clean_text(text: str) -> str:
    text = text.strip(BLANKS)
    if re.search(r"[&\n\r［］（）]", text):
        text = _decoded(_decoded(text, _COMMON_PASSES, True), _LETTERS_PASSES, False)
    return text.strip(BLANKS)


@F.pandas_udf(T.StringType())
def common_filter(c: pd.Series) -> pd.Series:
    """Entities of both tables decoded in their order, line breaks as escapes, blanks off both ends."""
    return c.map(lambda s: None if s is None else clean_text(s))


def separate_left(c: Column, mark: str) -> Column:
    """What is before the first ``mark``, or everything."""
    return F.when(F.instr(c, mark) > 0, F.substring_index(c, mark, 1)).otherwise(c)


def separate_right(c: Column, mark: str) -> Column:
    """What is after the first ``mark``, or everything."""
    return F.when(F.instr(c, mark) > 0, F.substr(c, F.instr(c, mark) + len(mark))).otherwise(c)


def trim_of(c: Column, chars: str) -> Column:
    """Without any of ``chars`` at both ends."""
    return F.btrim(c, F.lit(chars))


def between(text: str, begin: str, end: str) -> str:
    """The text after the first ``begin`` up to the ``end`` that balances it; all of it where either is missing."""
    if text == begin + end:
        return ""
    at = text.find(begin)
    rest = text[at + len(begin) :]
    if at < 0 or end not in rest:
        return text
    depth = 1
    for i in range(len(rest) - len(end) + 1):
        if rest.startswith(end, i):
            depth -= 1
            if not depth:
                return rest[:i]
        if rest.startswith(begin, i):
            depth += 1
    return rest[: len(rest) - len(end) + 1]


def get_between(c: Column, begin: str, end: str) -> Column:
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else between(x, begin, end))

    return run(c)


def status_code(c: Column, *words: str) -> Column:
    """The code of the first status of which a ``|``-separated word is in the text, ``Unknown`` if none, '' for no text."""
    low, out = F.lower(c), F.lit("Unknown")
    for (code, word), given in reversed(list(zip(STATUSES, [*words, *[w for _, w in STATUSES[len(words) :]]], strict=True))):
        hits = [F.contains(low, F.lit(w.lower())) for w in given.split("|") if w]
        for hit in hits:
            out = F.when(hit, code).otherwise(out)
    return F.when(c == "", "").otherwise(out)


def status_name(c: Column) -> Column:
    """The name of a status code."""
    names = {"0": "completed", "1": "ongoing", "2": "hiatus", "3": "cancelled"}
    return F.coalesce(*[F.when(c == k, v) for k, v in names.items()], F.lit("unknown"))


def format_of(c: Column) -> Column:
    """A series' kind as a format facet."""
    return F.when(c.isin("manga", "manhwa", "manhua", "oel"), c).otherwise("other")


def publication_of(c: Column) -> Column:
    """A series' state as a publication facet; null for others."""
    return F.when(c == "releasing", "ongoing").when(c.isin("completed", "hiatus", "cancelled"), c)


_SCHEME = re.compile(r"([^:/]*)://(?=.)", re.S)
_PORT = re.compile(r"([^:/]*):([0-9]+)", re.S)


def split_url(url: str | None) -> tuple[str, str]:
    """``scheme://host[:port]`` and ``/path``, either maybe empty.

    What stands before the path is a host if it has a scheme or a port, or a dot that is not its last character; with
    nothing after it, a bare name needs two dots. https stands in for a missing scheme.
    """
    rest = (url or "").strip(BLANKS)
    if rest.startswith("/") and not rest.startswith("//"):
        return "", rest if len(rest) > 1 else ""
    scheme = port = host = ""
    if m := _SCHEME.match(rest):
        scheme, rest = m[1], rest[m.end() :]
    if m := _PORT.match(rest):
        port, rest = m[2], m[1] + rest[m.end() :]
    rest = rest.lstrip(".:/")
    head, slash, tail = rest.partition("/")
    dot = head.find(".")
    if 0 <= dot < len(rest) - 1 and (slash or 0 <= head.find(".", dot + 1) < len(head) - 1):
        host, rest = head, tail.lstrip(".:/")
    elif rest and (scheme or port):
        host, rest = rest, ""
    if host:
        host = f"{scheme or 'https'}://{host}" + (f":{port}" if port else "")
    return host, "/" + rest if rest else ""


@F.pandas_udf(T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType())]))
def url_parts(c: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([split_url(x) for x in c], columns=["host", "path"])


def fill_host(root: Column, url: Column) -> Column:
    """A link without a host gets the root's."""
    parts = url_parts(url)
    bare = (parts["host"] == "") & (parts["path"] != "")
    return F.when(bare, F.concat(F.regexp_replace(root, "/+$", ""), parts["path"])).otherwise(url)


def normal_url(c: Column) -> Column:
    """Without blanks, colons and slashes before it, special characters escaped unless it holds an escape, with a scheme."""
    t = F.regexp_replace(F.regexp_replace(c, r"^[:/\x00-\x20]+", ""), r"[\x00-\x20]+$", "")
    escaped = t.rlike(r"%(?:[0-9A-Fa-f]{2}|[\r\n]|.?$)")
    special = F.regexp_replace(F.url_encode(t), r"\+", "%20")
    for ch in "!#$&'()*+,-./:;=?@_~":  # all but the characters that are special in addresses
        special = F.regexp_replace(special, f"%{ord(ch):02X}", "\\" + ch)
    u = F.when(escaped, t).otherwise(special)
    return F.when((u == "") | F.contains(u, F.lit("://")), u).otherwise(F.concat(F.lit("https://"), u))


def absolute(root: Column, link: Column) -> Column:
    """A link on the site at ``root``; one with a scheme stays."""
    return F.when(F.contains(link, F.lit("://")), link).otherwise(F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"), F.regexp_replace(link, "^/", "")))


def link_forms(root: Column, link: Column) -> Column:
    """The link as given, absolute, and relative to its root, each once."""
    base = F.regexp_replace(F.coalesce(root, F.lit("")), "/+$", "")
    path = F.when(F.startswith(link, F.concat(base, F.lit("/"))), F.substr(link, F.length(base) + 1))
    return F.when(base == "", F.array(link)).otherwise(F.array_distinct(F.array_compact(F.array(link, absolute(base, link), path))))


def all_words(c: Column, query: str) -> Column:
    """Every word of the query is in the text, case ignored; no word, any text."""
    out = F.lit(True)
    for word in query.lower().split():
        out = out & F.contains(F.lower(c), F.lit(word))
    return out


def chapter_label(names: Column, current: Column) -> Column:
    """The current chapter's name, and its place where there are several."""
    at = F.greatest(F.least(current, F.size(names) - 1), F.lit(0))
    name = F.coalesce(F.get(names, at), F.lit(""))
    return F.when(F.size(names) > 1, F.concat(name, F.lit(" ("), (at + 1).cast("string"), F.lit("/"), F.size(names).cast("string"), F.lit(")"))).otherwise(name)
