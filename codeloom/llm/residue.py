"""Template residue, filler, error pages and script notices in place of content (problem 9).

Method: the segments of all texts (sentences and lines, code and quotations put aside) are reduced to
skeletons. A slot that keeps a template's own marks is residue. Records of one template are aligned by the frame
around a value, which shows the slots without marks; one that keeps a variable's name, a default or a blank is
residue. A page whose whole text, without navigation, is a skeleton met in many documents and worded as an error
or a notice is an error page.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.prefilter import Finder, Guarded
from codeloom.session import materialize

_CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]*`|<(?P<tag>code|pre)>.*?</(?P=tag)>", re.S)
_QUOTED = re.compile(r"\"[^\"\n]{1,300}\"|“[^”\n]{1,300}”|„[^“\n]{1,300}“|«[^»\n]{1,300}»")
_BREAK = re.compile(r"\n+|(?<=[.!?…])[ \t]+(?=[A-ZÄÖÜ¡¿(<\[{$@_%§0-9])")

#: Slots that still hold a template's own notation: a name or an instruction between the marks of a template language.
_NAME = r"[A-Za-z][\w .-]{0,40}"
SLOT = re.compile(
    rf"\{{\{{\s*{_NAME}\s*\}}\}}|\{{%\s*{_NAME}\s*%\}}|<%=?\s*{_NAME}\s*%>|\$\{{\s*{_NAME}\s*\}}|\$[A-Za-z][A-Za-z_ ]{{1,30}}\$|@@\s*{_NAME}\s*@@"
    rf"|(?<!\w)__[A-Za-z][A-Za-z_ ]{{1,30}}?__(?!\w)|%\(\s*{_NAME}\s*\)[sd]|\[\[\s*{_NAME}\s*\]\]"
    r"|\[\s*(?:your|insert|enter|add|replace|placeholder|todo|tbd|name|company|date)\b[^\]\n]{0,60}\]|<\s*(?:your|insert|enter)\b[^>\n]{0,60}>"
    r"|(?<![\w<])<[A-Za-z]+(?:[ _][A-Za-z]+)*>(?!\w)|(?<![\w{$])\{[A-Za-z]+(?:[ _][A-Za-z]+)*\}(?![\w}])|<!--(?:[^-]|-(?!->))*-->|_{4,}|\bX{4,}\b",
    re.I,
)
#: Element names, so that markup is not taken for a slot.
_ELEMENTS = frozenset(
    "a abbr article aside b blockquote body br button center code dd details div dl dt em footer form h1 h2 h3 h4 h5 h6 head header hr html i img input kbd li link main meta nav noscript ol p pre q s samp script section small span strong style sub summary sup table tbody td th thead title tr u ul var".split()
)
#: The words of the usual filler text.
_LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)

#: Words typed to fill space.
_TYPED = frozenset("foo bar baz qux quux asdf qwer qwerty hjkl sdfg zxcv blah bla xxx yyy zzz test testing words word etc tbd todo lorem ipsum".split())

_THING = r"(?:text|copy|content|contents|summary|paragraph|description|title|body|section|inhalt|words?)"
FILLER = re.compile(
    rf"(?i)^\W*(?:this is (?:a )?)?(?:dummy|sample|example|placeholder|filler)\s+{_THING}\W*$|^\W*(?:type|insert|put|paste|enter|add|write)\s+(?:your |the |some )?{_THING}\s+here\W*$"
    rf"|\b{_THING}\s+(?:goes|belongs|comes|will (?:be added|go|come)|should go|to come)\s+(?:here|later)\b|\breplace this (?:line|text|paragraph|section)\b|\bonly here to fill\b|\bswap it out\b"
    rf"|^\W*do not publish\W*$|\blines like this one\b|\b(?:coming soon|under construction|to be written)\W*$|^\W*(?:some|more|your|the real)\s+{_THING}\s+(?:goes|comes|belongs|will)\b"
    r"|\bblindtext\b|\bnur zum füllen\b|^\W*hier (?:folgt|kommt|steht)\b.{0,60}\b(?:text|inhalt)\b|^\W*texto de (?:relleno|muestra|prueba|ejemplo)\b|\bsolo ocupa espacio\b"
    r"|^\W*describe the bug:\s*\(|^\W*todo: describe\b|^\W*\(?a clear description of\b"
)
_REASON = r"(?:bad request|unauthorized|authorization required|payment required|forbidden|not found|method not allowed|request timeout|conflict|gone|too many requests|internal server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out)"
ERROR = re.compile(
    rf"(?i)^\W*(?:error\s*:?\s*)?[45]\d\d\W+{_REASON}|^\W*{_REASON}\W*$|<h1>\s*(?:error )?[45]\d\d\b|<title>\s*(?:error )?[45]\d\d\b|^\W*(?:http )?error (?:code )?[45]\d\d\b"
    r"|\bserver (?:could not|was unable to|cannot|can't|did not) \w+ (?:your|the) request\b|\bupstream (?:connect error|request timeout|closed the connection)\b"
    r"|\b(?:something (?:went wrong|broke)|an? (?:unexpected |internal )?error (?:has )?occurred|we hit a problem|we (?:ran|have run) into a problem)\b"
    r"|\byour (?:\w+ )?(?:session|login|link|token|password|account|access)(?: \w+)? has (?:expired|ended|timed out|been (?:locked|suspended|logged out))\b|^\W*(?:sign|log) in again\b"
    r"|^\W*(?:access|permission) (?:is |was )?denied\b|^\W*not authori[sz]ed\b|^\W*restricted area\b|^\W*forbidden\W*$|\byou (?:do not|don't) have (?:the )?(?:permission|rights|access)\b|\byou lack (?:the )?(?:permissions?|rights)\b|\baccount is not allowed to\b"
    rf"|\b(?:that|this|the)\s+\w+\s+(?:that |which )?you\s+(?:asked|requested|tried|were|are|want|wanted|followed|need)\b.{{0,40}}\b(?:exists?|here|available|gone|found|moved|removed|deleted|missing)\b"
    r"|\btoo many requests from\b|\brate limit (?:reached|exceeded)\b|\bunusual traffic from\b"
    r"|\b(?:down for|under|closed for|undergoing) (?:scheduled |planned )?(?:maintenance|an upgrade)\b|\bwill be back (?:soon|shortly|at)\b"
    r"|\b(?:page|file|address|document|resource|url|site|link)\b.{0,40}\b(?:(?:was|is|be|were)(?: not|n't) found|not found|does not exist|doesn't exist|no longer exists?|has been (?:moved|removed|deleted)|cannot be (?:found|displayed|reached)|can't be found|could not be found|is (?:not|no longer) available|unavailable)\b"
    r"|\b(?:nothing (?:here|at this address)|we (?:could not|couldn't|cannot|can't) find (?:the |that |this |any)?(?:page|file|address|document|what)\w*)\b"
    r"|^\W*\w+ (?:nicht (?:gefunden|verfügbar|erreichbar)|gesperrt)\W*$|\bfehlercode \d|\bversuchen sie es später\b|\bgibt es nicht(?: mehr)?\W*$|\b(?:interner|unerwarteter) (?:server)?fehler\b|\bzugriff (?:verweigert|gesperrt)\b|\bkeine berechtigung\b|\b(?:sitzung|anmeldung) ist abgelaufen\b"
    r"|^\W*\w+ no (?:encontrad[ao]|disponible)\W*$|\berror interno\b|\bvuelva a intentarlo\b|\bcompruebe la dirección\b|^\W*código \d+\W*$|\bacceso (?:denegado|prohibido)\b|\bsesión ha (?:caducado|expirado|terminado)\b|\bno tiene permiso\b"
)
_ANSWER = re.compile(r"(?i)^\W*\{\s*\"(?:error|errors|status|code|message|detail)\"\s*:\s*(?:\{\s*\"(?:code|status|message)\"\s*:\s*)?\"?(?:[45]\d\d\b|error\b|fail(?:ed|ure)?\b)")
_SCRIPTS = r"(?:java\s?script|js|scripting|(?:client-side )?scripts?|skripte?)"
SCRIPT = re.compile(
    rf"(?i)<noscript>|\b(?:enable|activate|allow|permit|turn(?:ing)? on|switch(?:ing)? on|unblock|requires?|needs?|relies on|depends on|without|habilite|active|activar|permita|aktivieren|erlauben)\b[^.!?]{{0,40}}\b{_SCRIPTS}\b"
    rf"|\b{_SCRIPTS}\b(?: and cookies)? (?:is|are|seems?|appears?|must|has|have|needs?)(?: to)?(?: be)?\s*(?:blocked|disabled|off|turned off|switched off|not (?:enabled|available|supported|allowed)|missing|required|needed|enabled|allowed|on|active)\b"
    rf"|\b(?:only|works|run|shown|used)\b.{{0,30}}\bwith {_SCRIPTS}\b.{{0,12}}\b(?:on|enabled|allowed|active)\b|\bblocks? {_SCRIPTS}\b|\b(?:turn|switch) (?:on )?{_SCRIPTS}(?: back)? on\b"
    rf"|\bchecking your browser before\b|\byour browser (?:cannot|can't|can not|does not|doesn't|did not|is (?:not able|unable) to|blocks|has)\b.{{0,30}}\b{_SCRIPTS}\b|\b{_SCRIPTS}\b.{{0,40}}\bin your browser\b|\btoo old for this\b"
)
#: Statements about scripts and errors, not notices to a reader.
_TOLD = re.compile(r"(?i)\bfalls back\b|\bfor \d+ %|\bturns into\b|\breturns? [45]\d\d\b|\banswer(?:s|ed)\b|\bwho saw\b|\bwe (?:replaced|raised|fixed|renamed|removed|added)\b")
_HEDGED = re.compile(r"(?i)\bwhether\b|\botherwise\b")
_ADDRESSED = re.compile(r"(?i)^\W*(?:please\s+)?(?:check|verify|make sure|see|find out|enable|activate|allow|turn|switch)\b|\byour?\b")
_CHROME = re.compile(
    r"(?i)^\W*(?:use the search|go back to|check the (?:link|address|url)|try again|please try|return to|turn (?:them|it) on|change your browser|reload|open the \w+ again|contact (?:support|the|your)|request id\b|ray\b|reference\b|uh oh|oops|sorry|hmm|loading)\b[^.!?]{0,60}[.!?…]*\W*(?:\([^()]*\))?\W*$|^\W*(?:home|docs?|issues|search|sign in|log ?in|sign up|menu|about|contact|terms|privacy|status(?: page)?|cookie settings|skip to content|help|blog|pricing|faq|imprint|loading\W*)(?:\s*[|/•·>-]\s*.*)?\W*$|^\W*(?:\(c\)|©|copyright)\b.*$|\ball rights reserved\b"
)
_MASK = re.compile(r"\b(?=\w*\d)[0-9a-f]{6,}\b|\d+(?:[.,:]\d+)*", re.I)
_ANY_WORD = re.compile(r"[^\W\d_]+")

#: Values that nobody filled in, without a mark around them: a variable's name or a default of a template.
UNFILLED = re.compile(
    r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+|(?:[a-z]+_)+(?:name|version|date|team|owner|url|e?mail|id|title|author|release|project|user|company)|(?:your|my)_[a-z_]+"
    r"|TODO|TBD|TBA|FIXME|(?i:changeme|placeholder|untitled|unnamed|undefined|unset)"
)
#: What a line needs for such a value, or for a gap before a mark.
_MAY_HOLD = re.compile(r"[A-Z0-9]_[A-Z0-9]|_(?:name|version|date|team|owner|url|e?mail|id|title|author|release|project|user|company)\b|(?:your|my)_|\s[,.;](?:\s|$)|TODO|TBD|TBA|FIXME|(?i:changeme|placeholder|unnamed|un(?:title|define|se))")
#: The part of UNFILLED without underscores, in lower case.
_DEFAULTS = frozenset("todo tbd tba fixme changeme placeholder untitled unnamed undefined unset".split())
_PIECE = re.compile(r"\w+|[^\w\s]")
_LAST = re.compile(r"(?:\w+|[^\w\s])(?=\s*\Z)")
_OPEN_LABEL = re.compile(r":\s*(?:\n|\Z)")
_LABEL = re.compile(r"\s*(?:[-*#>]+\s*)?[^\W\d][^:\n]{0,40}:")
#: The longest value in tokens, and the size of the bit maps that the values' frames are first looked up in.
VALUE, BITS = 6, 1 << 20


#: Derived from the patterns: every match has one of these.
_SLOT, _FILLER, _ERROR, _ANSWERS, _SCRIPT, _CHROMES = (Guarded(x) for x in (SLOT, FILLER, ERROR, _ANSWER, SCRIPT, _CHROME))
_RESIDUE = _SLOT.required | _FILLER.required | _ERROR.required | _ANSWERS.required | _SCRIPT.required
#: Filler is only looked for beside one of its longer words.
_FILL = frozenset(w for w in _LOREM | _TYPED if len(w) > 2)
triggers = Finder(_RESIDUE | _CHROMES.required | _FILL)


def prose_of(text: str) -> str:
    """The text with a mark for each piece of code."""
    return _CODE.sub("¤", text.replace("\r\n", "\n").replace("\r", "\n"))


def segments(text: str, prose: str | None = None) -> list[str]:
    """Sentences and lines of the prose; code is replaced by a mark."""
    return [s for s in (x.strip() for x in _BREAK.split(prose_of(text) if prose is None else prose)) if s]


def open_slots(segment: str) -> list[str]:
    """The slots of a segment that still hold a template's notation."""
    out = []
    for m in SLOT.finditer(segment):
        word = re.fullmatch(r"<\s*/?([A-Za-z0-9]+)\s*>", m.group())
        if not (word and word[1].lower() in _ELEMENTS and not (word[1].lower() == "summary" and "</summary" not in segment.lower())):
            out.append(m.group())
    return out


def is_navigation(segment: str, here: set[str]) -> bool:
    """A list of links in one line, or a page's fixed line; ``here``: its triggers."""
    for mark in (" | ", " / ", " - ", " • ", " · ", " > "):
        parts = segment.split(mark) if mark in segment else ()
        if len(parts) >= 3 and all(len(p) <= 60 and p[-1:] not in ".!?" for p in parts):
            return True
    return len(segment) <= 300 and _CHROMES.found(segment, here)


def _lorem(segment: str) -> bool:
    found = _ANY_WORD.findall(segment.lower())
    n = len(found)
    return n >= 4 and (sum(w in _LOREM for w in found) >= 0.7 * n or sum(w in _TYPED for w in found) >= 0.8 * n)


def describe(segment: str) -> tuple[str, str, int]:
    """(kind, skeleton, open slots) of a segment; kind is slot, filler, error, script, chrome, title or text."""
    here = triggers(segment)
    may_fill = not _FILL.isdisjoint(here)
    if _RESIDUE.isdisjoint(here) and not (may_fill and _lorem(segment)):
        if is_navigation(segment, here):
            return "chrome", "", 0
        short = len(segment) <= 70 and segment[-1:] not in ".!?:;" and segment.count(" ") < 8
        return "title" if short else "text", "", 0
    has_slots = _SLOT.found(segment, here)
    slots = open_slots(segment) if has_slots else []
    bare = _QUOTED.sub("¤", segment)
    skeleton = _MASK.sub("#", (SLOT.sub("□", bare) if has_slots else bare).lower())
    if slots:
        return ("error" if _ERROR.found(segment, here) else "script" if "noscript" in segment and _SCRIPT.found(segment, here) else "slot"), skeleton, len(slots)
    if may_fill and _lorem(bare) or _FILLER.found(bare, here):
        return "filler", skeleton, 0
    script, answer, error = _SCRIPT.found(bare, here), _ANSWERS.found(segment, here), _ERROR.found(bare, here)
    if script or error:
        told = _TOLD.search(bare) or _HEDGED.search(bare) and not _ADDRESSED.search(bare)
        script, error = script and not told, error and not told
    if script:
        return "script", skeleton, 0
    if answer or error:
        return "error", skeleton, 0
    if is_navigation(segment, here):
        return "chrome", skeleton, 0
    if len(segment) <= 70 and segment[-1:] not in ".!?:;" and segment.count(" ") < 8:
        return "title", skeleton, 0
    return "text", skeleton, 0


def _pieces(segment: str) -> tuple[list[str], list[str], bytes, list[int]]:
    """Tokens, the same in lower case without numbers, these joined, and where each begins."""
    tokens = _PIECE.findall(segment)
    same = ["#" if t[0].isdigit() else t.lower() for t in tokens]
    at, joined = [0], b""
    for t in same:
        joined += t.encode("utf-8", "replace") + b" "
        at.append(len(joined))
    return tokens, same, joined, at


def _frame(before: int, after: bytes, end: bool) -> int:
    return (before << 31) ^ zlib.crc32(after + (b"\n" if end else b""))


@functools.lru_cache(maxsize=1 << 16)
def _token_hash(token: str) -> int:
    return zlib.crc32(("#" if token[0].isdigit() else token.lower()).encode("utf-8", "replace"))


def unfilled_values(text: str, prose: str | None = None) -> set[tuple[int, int, int, int, str]]:
    """(before, frame, first, last, value) of the values without marks that may be left open: names, defaults and blanks.

    A frame is the segment up to the value and from it on to its end, or to the next open value. It needs a
    label or three words. A blank is the end of a label without a value in the next line, or a gap before a mark.
    ``first`` is the first token of the segment, ``last`` its last one where the value comes first, else 0.
    """
    prose = prose_of(text) if prose is None else prose
    if not (_OPEN_LABEL.search(prose) or _MAY_HOLD.search(prose)):
        return set()
    lines = prose.split("\n")
    out = set()
    for k, line in enumerate(lines):
        blank_end = line.rstrip()[-1:] == ":" and bool(_LABEL.fullmatch(line.rstrip()))
        if blank_end and k + 1 < len(lines) and lines[k + 1].strip() and not _LABEL.match(lines[k + 1]):
            blank_end = False
        if not (blank_end or _MAY_HOLD.search(line)):
            continue
        for segment in (x.strip() for x in _BREAK.split(line)):
            bare = re.sub(r"(?<=\w)[ \t]+(?=[,.;](?:\s|$))", " \u0002 ", _QUOTED.sub("¤", segment))
            cased = any(c.islower() for c in bare)
            # part of a path, a call or an expression is no value
            alone = lambda m: not re.match(r"[\w/:.\\(\[{<$%@'\"-]", bare[m.start() - 1 : m.start()]) and re.match(r"[,.;:!?)]*(?:\s|$)", bare[m.end() :])
            pieces = list(_PIECE.finditer(bare))
            tokens = [m.group() for m in pieces]
            open_at = {i for i, m in enumerate(pieces) if tokens[i] == "\u0002" or cased and ("_" in tokens[i] or i and tokens[i].lower() in _DEFAULTS) and UNFILLED.fullmatch(tokens[i]) and alone(m)}
            open_at |= {len(tokens)} if blank_end else set()
            tokens = tokens + ["\u0002"] if blank_end and segment and line.rstrip().endswith(segment) else tokens
            holes = [i for i in sorted(open_at) if i < len(tokens)]
            for n, i in enumerate(holes):
                end = holes[n + 1] if n + 1 < len(holes) else len(tokens)
                before, after = tokens[:i], tokens[i + 1 : end]
                if n or not (before and before[-1] in (":", "=") or sum(t[0].isalpha() for t in before + after) >= 3) or not before and end < len(tokens):
                    continue
                left = zlib.crc32(_pieces(" ".join(before))[2])
                first, last = (_token_hash(before[0]), 0) if before else (0, _token_hash(after[-1]) if after else 0)
                out.add((left, _frame(left, _pieces(" ".join(after))[2], end == len(tokens)), first, last, tokens[i].strip("\u0002").lower()))
    return out


def values_in_frames(text: str, befores: bytes, frames: bytes, firsts: bytes, lasts: bytes) -> set[tuple[int, str]]:
    """(frame, value) for the frames in the maps that the text's segments fill with a value of their own.

    Only segments that begin with a frame's first token, or end with the last one of a frame that begins with its value, are
    taken apart.
    """
    out, some_last = set(), 1 in lasts
    for segment in segments(text):
        opening, closing = _PIECE.match(segment), _LAST.search(segment) if some_last else None
        if opening and not firsts[_token_hash(opening.group()) % BITS] and segment[0] not in '"“„«':
            if not closing or not lasts[_token_hash(closing.group()) % BITS] and segment[-1] not in '"”“»':
                continue
        bare = _QUOTED.sub("¤", segment)
        tokens, same, joined, at = _pieces(bare)
        n, left = len(tokens), 0
        for i in range(n):
            if i:
                left = zlib.crc32(joined[at[i - 1] : at[i]], left)
            if not befores[left % BITS]:
                continue
            for j in range(i + 1, min(n, i + VALUE) + 1):
                if same[j - 1] in (";", ":", "¤"):
                    break
                ends = range(j + 1, n) if i else ()
                for key in [_frame(left, joined[at[j] :], True), *(_frame(left, joined[at[j] : at[e]], False) for e in ends)]:
                    if frames[key % BITS]:
                        value = " ".join(tokens[i:j])
                        if any(t[0].isalnum() for t in tokens[i:j]) and not any(UNFILLED.fullmatch(t) for t in tokens[i:j]):
                            out.add((key, value.lower()))
    return out


def unfilled_slots(documents: DataFrame, held: DataFrame) -> DataFrame:
    """(doc_id, frame): documents with a name, default or blank where other records of the template have values of their own.

    ``held``: the open values of the documents, with their frames. Records are aligned by the frame around a possible
    value. The position is a slot if it varies: two values or more elsewhere, and more than twice as many as there are
    different names in it.
    """

    def bits(column: str, rows: DataFrame = held) -> bytes:
        out = bytearray(BITS)
        for (k,) in rows.select(F.pmod(F.col(column), F.lit(BITS)).cast("int")).distinct().collect():  # at most BITS rows
            out[k] = 1
        return bytes(out)

    befores, frames = bits("before"), bits("frame")
    firsts, lasts = bits("first", held.where("first <> 0")), bits("last", held.where("last <> 0"))

    def own_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted({x for t in batch.column(0).to_pylist() if t for x in values_in_frames(t, befores, frames, firsts, lasts)})
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.string()))], ["frame", "value"])

    names = held.groupBy("frame").agg(F.count_distinct("value").alias("names"))
    values = documents.select("text").mapInArrow(own_values, "frame long, value string").join(names.select("frame"), "frame", "left_semi")
    slots = values.distinct().groupBy("frame").agg(F.count(F.lit(1)).alias("values")).join(names, "frame")
    slots = slots.where("values >= 2 and values > 2 * names").select("frame")
    return held.join(slots, "frame", "left_semi").select("doc_id", "frame").distinct()


def page_passages(text: str) -> int:
    """Lines of four words or more that are an error or notice as a whole, and runs of page segments with one in it."""
    found, run = 0, []
    for line in [*prose_of(text).split("\n"), ""]:
        kinds = [describe(x.strip())[0] for x in _BREAK.split(line) if x.strip()]
        if kinds and set(kinds) <= {"error", "script", "chrome", "title"} and {"error", "script"} & set(kinds):
            found += len(_ANY_WORD.findall(line)) >= 4 and not re.match(r"\s*(?:[-*+>]|\d+[.)])\s", line)
        for kind in [*kinds, ""] if line.strip() else [""]:
            if kind in ("error", "script", "chrome"):
                run.append(kind)
            else:
                found += len(run) >= 2 and bool({"error", "script"} & set(run))
                run = []
    return found


_SCHEMA = (
    "doc_id long, kind string, skeleton string, n_slots int, n int, n_text int, page string, n_passages int,"
    " before long, frame long, first long, last long, value string"
)


def text_segments(documents: DataFrame) -> DataFrame:
    """A row per document and segment that could be residue, with the document's count of ordinary segments and its page skeleton.

    Rows of kind held are the document's unfilled_values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
        fields = [(f.split()[0], kinds[f.split()[1]]) for f in _SCHEMA.split(",")]
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if doc is None or not text:
                    continue
                told: dict[tuple, int] = {}
                ordinary, prose = 0, prose_of(text)
                for s in segments(text, prose):
                    kind, skeleton, n = describe(s)
                    ordinary += kind == "text"
                    if kind not in ("text", "chrome", "title"):
                        told[kind, skeleton, n] = told.get((kind, skeleton, n), 0) + 1
                page = " / ".join(sorted({s for k, s, _ in told}))
                passages = page_passages(text) if ordinary and any(k in ("error", "script") for k, _, _ in told) else 0
                out += [(doc, k, s, n, c, ordinary, page, passages, None, None, None, None, None) for (k, s, n), c in told.items()]
                out += [(doc, "held", None, None, None, None, None, None, *x) for x in unfilled_values(text, prose)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, (_, k) in enumerate(fields)], [f for f, _ in fields])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)


def residue(documents: DataFrame) -> DataFrame:
    """(doc_id, kinds, n_slots, template_docs): documents with residue in place of content.

    ``kinds``: which of slot, filler, error, script. ``template_docs``: the documents that share the most common
    skeleton among its residue. A filled template (code and quotations aside) has no open slot and isn't
    residue. An error or notice counts if it is the page: at most as many ordinary segments beside it as
    segments of its kind, or twice as many where its whole page skeleton is met in three documents or more. In a
    longer text it counts as a passage: see page_passages. A bare status such as 'Access denied.' is none.
    Null and empty texts, and empty tables, give no rows; a repeated document is one row; extra columns are
    ignored. A slot's name has at most 41 characters and a quotation 300: what is longer between such marks is prose, and
    is looked at as such. Texts of any length are looked at whole.
    """
    scanned = materialize(text_segments(documents))
    unmarked = unfilled_slots(documents, scanned.where("kind = 'held'")).select(
        "doc_id", F.lit("slot").alias("kind"), F.concat(F.lit("frame "), F.col("frame")).alias("skeleton"), F.lit(1).alias("n_slots"),
        F.lit(1).alias("n"), F.lit(0).alias("n_text"), F.lit("").alias("page"), F.lit(0).alias("n_passages"),
    )
    found = materialize(scanned.where("kind <> 'held'").select(unmarked.columns).unionByName(unmarked))
    aligned = found.groupBy("skeleton").agg(F.count_distinct("doc_id").alias("docs"))
    pages = found.where("kind in ('error', 'script')").select("doc_id", "page").distinct().groupBy("page").agg(F.count(F.lit(1)).alias("page_docs"))
    per_doc = (
        found.join(aligned, "skeleton")
        .groupBy("doc_id")
        .agg(
            F.array_sort(F.collect_set("kind")).alias("all_kinds"),
            F.sum(F.col("n_slots") * F.col("n")).alias("n_slots"),
            F.sum(F.when(F.col("kind").isin("error", "script"), F.col("n")).otherwise(0)).alias("n_page"),
            F.max("n_passages").alias("n_passages"),
            F.sum(F.when(F.col("kind").isin("slot", "filler") | (F.col("n_slots") > 0), F.col("n")).otherwise(0)).alias("n_part"),
            F.max("n_text").alias("n_text"),
            F.max("page").alias("page"),
            F.max("docs").alias("template_docs"),
        )
        .join(pages, "page", "left")
    )
    is_page = (F.col("n_page") > 0) & (
        (F.col("n_text") <= F.col("n_page")) | ((F.col("page_docs") >= 3) & (F.col("n_text") <= 2 * F.col("n_page")))
    )
    is_page = is_page | (F.col("n_passages") > 0)
    kept = F.filter("all_kinds", lambda k: k.isin("slot", "filler") | is_page)
    kept = F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("slot")))
    return per_doc.where((F.col("n_part") > 0) | is_page).select("doc_id", kept.alias("kinds"), "n_slots", "template_docs")
