"""Lexical classes, permissible neighbours and statement productions of the languages.

A text is lexed into one character per token:

    i name   0 number   s string   K keyword   T type word or modifier
    C control word (its condition in brackets follows)   R return or jump
    = assignment   + plus or minus   * star or ampersand   / other binary operator
    ! prefix operator   u ++ or --   . member access   ? , ; : and brackets   n line end
    a => or ->   @ annotation

Neighbours follow from the grammar's roles (:func:`neighbours`): what can end
an operand, begin one, or stand between two. Bracket groups are then reduced
from the inside out to ``p`` (), ``b`` [] and ``B`` {}, checking what each
window holds; a bracket that is left over is unbalanced.
"""

from __future__ import annotations

import re
from functools import cache

#: Reserved words by role.
_WORDS = {
    "c": ("return goto break continue sizeof else do case default", "int char void long short unsigned signed float double struct union enum static const extern inline typedef volatile register restrict auto bool size_t", "if while for switch"),
    "java": (
        "return break continue else do case default new throw try finally instanceof extends implements import package this super null true false assert yield throws permits",
        "int char void long short float double boolean byte final static public private protected abstract synchronized native transient volatile class interface enum record var sealed strictfp default", "if while for switch catch synchronized"),
    "javascript": (
        "return break continue else do case default new throw try finally typeof instanceof in of delete void yield await async import export from as extends this super null true false get set static function class let const var debugger", "", "if while for switch catch with"),
    "go": ("return break continue else case default go defer range fallthrough goto import package if for switch select func nil true false", "var const type struct interface map chan", ""),
    "rust": ("return break continue else in as if while for loop match move ref self Self super crate true false unsafe async await dyn where", "let mut const static pub fn mod use struct enum impl trait type extern union", ""),
}
_WORDS["c++"] = (
    _WORDS["c"][0] + " new delete throw try namespace using template typename operator this nullptr true false public private protected and or not co_return co_await",
    _WORDS["c"][1] + " class constexpr virtual explicit friend mutable override final noexcept decltype consteval constinit", "if while for switch catch",
)
_WORDS["typescript"] = (
    _WORDS["javascript"][0] + " type interface enum namespace declare abstract readonly implements private public protected keyof is infer satisfies override asserts unique module global", "", _WORDS["javascript"][2],
)

#: Words that other languages begin statements with; before a name they are no type.
_FOREIGN = {
    "c": "function let def import fn func package use pub from export interface public private protected class namespace template using create select insert update echo local elif fun val var mut impl",
    "c++": "function let def import fn func package use pub from export interface create select insert update echo local elif fun val var mut impl",
    "java": "function let def fn func use pub from export const namespace template using typedef struct unsigned create select insert update echo local elif fun val mut impl auto",
}
_KINDS = {g: {**{w: "K" for w in k.split()}, **{w: "T" for w in t.split()}, **{w: "C" for w in c.split()}} for g, (k, t, c) in _WORDS.items()}

_STRING = r'"(?:\\.|[^"\\\n])*"'
_CHAR = r"'(?:\\[^\n]{1,10}?|[^'\\\n])'"
_QUOTES = {
    "c": rf'(?:u8|[uUL])?{_STRING}|(?:[uUL])?{_CHAR}',
    "c++": rf'(?:u8|[uUL])?R"(?P<d>[^()\s\\]{{0,16}})\((?:.|\n)*?\)(?P=d)"|(?:u8|[uUL])?{_STRING}|(?:[uUL])?{_CHAR}',
    "java": rf'"""(?:\\.|[^\\])*?"""|{_STRING}|{_CHAR}',
    "javascript": rf"{_STRING}|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`",
    "go": rf"`[^`]*`|{_STRING}|{_CHAR}",
    "rust": rf'b?r(?P<h>#*)"(?:.|\n)*?"(?P=h)|b?"(?:\\.|[^"\\])*"|b?{_CHAR}',
}
_QUOTES["typescript"] = _QUOTES["javascript"]
_NOTES = r"//[^\n]*|/\*(?:.|\n)*?\*/"
_PLAIN = {g: re.compile(rf"(?P<c>{_NOTES})|(?P<s>{q})") for g, q in _QUOTES.items()}
_DIRECTIVE = re.compile(r"(?m)^[ \t]*#[ \t]*(?:include|define|undef|if|ifdef|ifndef|elif|else|endif|pragma|error|warning|line)\b(?:[^\n]*\\\r?\n)*[^\n]*$")
_CONFLICT = re.compile(r"(?m)^[ \t]*(?:<{7}|>{7})(?:[ \t]|\r?$)|^[ \t]*={7}[ \t]*\r?$")
_GENERIC = re.compile(r"(?<=\w)(?:::)?<(?:[\w\s,.&*:\[\]?|\"']|=>|\(\)|<(?:[\w\s,.&*:\[\]?|]|<[\w\s,.&*:\[\]?|]*>)*>)*>(?=\s*[\w(){};,.:>&*\[=?|!]|\s*$)")
_NUMBER = re.compile(r"(?<![\w$])(?:0[xX][0-9a-fA-F_]+|0[bBoO][0-7_]+|\d[\d_]*(?:\.(?!\.)[\d_]*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)(?:[uUlLfFdDn]+|[iuf](?:8|16|32|64|128|size))?(?![\w])")
_NAME = re.compile(r"[^\W\d][\w$]*|\$[\w$]*")
_OPERATORS = re.compile(r">>>=|<<=|>>=|\*\*=|&&=|\|\|=|\?\?=|\.\.\.|\.\.=|===|!==|>>>|=>|->|<-|:=|::|\?\.|\.\.|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|==|!=|<=|>=|&&|\|\||\?\?|<<|>>|\*\*|&\^|[-+*&/%<>=|^!~?]")
_OPS = {
    **dict.fromkeys(">>>= <<= >>= **= &&= ||= ??= += -= *= /= %= &= |= ^= = :=".split(), "="), **dict.fromkeys("=== !== >>> == != <= >= && || ?? << >> ** &^ / % < > | ^".split(), "/"),
    **dict.fromkeys("+ -".split(), "+"), **dict.fromkeys("* &".split(), "*"), "!": "!", "~": "!", "++": "u", "--": "u", "=>": "a", "->": "a", "<-": "/", "::": ".", "?.": ".", "...": "!", "..": "/", "..=": "/", "?": "?",
}
_LINES = frozenset(("javascript", "typescript", "go"))
_OPEN, _CLOSE, _ENDS = "([{", ")]}", "i0sKT)]}u"
BRACKETED = frozenset(_QUOTES)


def lex(text: str, language: str) -> str | None:
    """One character per token, or None if something is no token of the language."""
    bare = _PLAIN[language].sub(lambda m: (" " if m.group("c")[:2] == "//" else " " + "\n" * m.group("c").count("\n")) if m.group("c") is not None else ' "" ', text)
    if language in ("c", "c++"):
        bare = _DIRECTIVE.sub("", bare)
    elif language == "rust":
        bare = re.sub(r"'[a-z_]\w*(?!')|#!?(?=\[)", " ", bare)
    elif language in ("javascript", "typescript"):
        bare = re.sub(r"\A#![^\n]*", "", bare)
        bare = re.sub(r"(?<=[=(,:\[!&|?{};])([ \t]*)/(?![*/ ])(?:\\.|\[[^\]\n]*\]|[^/\n\\])+/[a-z]*", r'\1""', bare)
    if _CONFLICT.search(bare):
        return None
    if language in ("java", "c++", "typescript", "rust"):
        bare = _GENERIC.sub("", bare)
    if language in ("go", "rust", "c++", "c"):
        bare = re.sub(r"(?<=[\w)])::<", "<", bare)
    bare = bare.replace('""', "\x01")
    bare = _NUMBER.sub("\x02", bare)
    kinds = _KINDS[language]
    bare = _NAME.sub(lambda m: kinds.get(m.group(), "i"), bare)
    bare = _OPERATORS.sub(lambda m: _OPS[m.group()], bare)
    bare = bare.translate(_TIDY)
    if language in _LINES:
        bare = re.sub(r"\n+", "n", bare)
    else:
        bare = bare.replace("\n", "")
    bare = bare.replace("\x01", "s").replace("\x02", "0")
    return None if _STRAY[language].search(bare) else bare


_TIDY = {ord(c): None for c in " \t\r\f\v\ufeff\u00a0"}
_STRAY = {g: re.compile(r"[^i0sKTCR=+*/!u.?,;:()\[\]{}na" + ("@" if g in ("java", "typescript", "javascript") else "") + ("$" if g == "rust" else "") + "]") for g in _QUOTES}


@cache
def neighbours(language: str) -> frozenset[str]:
    """The pairs of neighbouring tokens that the grammar permits."""
    ends = set("i0sKT)]}u")  # an operand or a word can end here
    begins = set("i0sKTC([{!+*u@")  # ... and begin here
    between = set("=+*/.?,;:an")  # stands after an operand
    out = {a + b for a in ends for b in between | set(_CLOSE)}
    out |= {a + b for a in between | set(_OPEN) | set("!+*u") for b in begins}
    out |= {a + b for a in _OPEN for b in set(_CLOSE) | set(";,n.:*/=")}
    out |= {a + b for a in ",;:n.a" for b in set(_CLOSE) | set(";n,.:")}
    out |= {a + b for a in "KTC" for b in begins | between | set(_CLOSE)} | {a + b for a in ends | set(";n") for b in "KTC"}
    out |= {a + "(" for a in "i)]}sC"} | {a + "[" for a in "i)]}s"} | {a + "{" for a in "i)]}0s"} | {a + "u" for a in "i)]"}
    out |= {"}" + b for b in begins | between} | {b + "n" for b in "=+*/!?@."} | {"n" + b for b in between}
    if language in ("c", "c++", "java"):
        out |= {"ii", ")i", ")0", ")s", ")!", ")u", ")+", ")*", "]i", "*)", "*,", "*i", "**", "*T", "i*", "ss", "is", "si", "@i", "i@", ")@", "*.", "*K", "/)", "/i", "*]", "*;", "*=", "?)", "?,", "?/", "!i", "!)", "!,"}
    elif language == "go":
        out |= {"ii", "i*", ")i", ")*", ")[", "]i", "]*", "i]", "/i", "is", "!i", "i!", "]!", "!)", "!,", "s=", "n=", ";K"}
    elif language == "rust":
        out |= {"!(", "![", "!{", "i!", ")!", "]!", "/i", "/,", "/)", "*i", "?;", "?.", "?)", "?,", "?n", "?}", "?/", "?+", "?=", "a!", "/a", "/{", "/=", "/]", "/>", "a+", "//", "/*"}
    elif language == "typescript":
        out |= {"?:", "?,", "?)", "!.", "!)", "!;", "!,", "!n", "![", "i!", ")!", "]!", "!=", "!/", "!+", "@i", "n@", "}@", "/i", "?(", "=/", ":/", "(/", "n/", "?/"}
    else:
        out |= {"@i", "n@", "}@", "?."}
    if language in ("javascript", "typescript"):
        out |= {")i", ")0", ")s", ")!", ")u"}  # a condition and its statement; others fail in their window
    # a member sign or an arrow needs something behind it, and a comma more than the end of a statement
    never = {a + b for a in ".a" for b in ")]};,:"} | {",;", ";,", ",:", "=;", "=,", "/;", "+;", "=)", "=]", "..", ".a", "a."}
    if language not in ("javascript", "typescript"):
        never |= {",,", "(,", "[,"}
    return frozenset(out - never)


_INNER = re.compile(r"\(([^()\[\]{}]*)\)|\[([^()\[\]{}]*)\]|\{([^()\[\]{}]*)\}")


def reduces(kinds: str, language: str) -> bool:
    """Whether all brackets match and what they hold can be statements, lists or fields."""
    ok = True

    def window(m: re.Match) -> str:
        nonlocal ok
        p, b, body = m.groups()
        if p is not None:
            if _BAD_PAREN[language].search(p):
                ok = False
            return "p"
        if b is not None:
            if ";" in b and language not in ("rust", "go") or _HOLE.search(b):
                ok = False
            return "b"
        if not block(body, language):
            ok = False
        return "B"

    before = None
    while ok and before != kinds:
        before = kinds
        kinds = _INNER.sub(window, kinds)
    return ok and not re.search(r"[()\[\]{}]", kinds) and block(kinds, language, top=True)


_HOLE = re.compile(r"[=+/.!]$")
_BAD_PAREN = {g: re.compile(r"[=+/.!?]$|,;|;,") for g in _QUOTES}
_BAD_PAREN["javascript"] = re.compile(r"[=+/.!?]$|^[^?]*(?<!K)i:|,;|;,")
_BAD_PAREN["rust"] = _BAD_PAREN["go"] = re.compile(r"[=+.]$|,;|;,")
_BAD_PAREN["c"] = _BAD_PAREN["c++"] = re.compile(r"[=+!?]$|,;|;,|^,")
_NEEDS_END = frozenset(("c", "c++", "java"))
_TRIPLE = re.compile(r"(?<![@.])iii")
_CONTROL = re.compile(r"C(?![pn*])")


def block(body: str, language: str, top: bool = False) -> bool:
    """Whether a reduced block is a row of statements, fields or list items."""
    if not body.strip("n;"):
        return True
    if language in _NEEDS_END:
        if top and language == "java" and body[0] in "Bpb0s":
            return False
        if _TRIPLE.search(body) or _CONTROL.search(body) and "Cpp" not in body and not re.search(r"T[CK]|C[BT]", body):
            return False
        last = body.rsplit(";", 1)[-1]
        tail = last[last.rfind("B") + 1 :] if "B" in last else last
        if not tail or ";" not in body and not top:
            # a list of values or constants, as in an initialiser or an enumeration
            return not _HOLE.search(body) or body.endswith(",")
        if tail.strip(",") == "" or re.fullmatch(r"(?:T|K)*:", tail):
            return True
        return ";" not in body and not top
    if language == "go":
        for s in re.split(r"[n;]", body):
            if s and (s[-1] in "=" or top and s[0] not in "KTp"):
                return False
        return True
    if language == "rust":
        if "ii" in body or re.search(r"[=.]$|0i|00|s0|0s|si|is(?!$)", body):
            return False
        if top:
            return all(re.match(r"[KTb]|i!|i\.i", s) for s in re.split(r";|(?<=B)", body) if s)
        return True
    for s in re.split(r"[n;]", body):
        if re.search(r"ii|i0|0i|00|s0|0s|si|is(?!$)|=$|KKKK|(?<!C)p[i0s]", s):
            return False
        # a call is followed by a block only in the body of a class or object
        if re.search(r"(?<![K*.])ipB", s) and (top or not re.search(r"(?:^|[,B])ipB", s)):
            return False
        if _CONTROL.search(s) and not re.search(r"[.,B]C|^C[p:,]|C[B:,]", s):
            return False
        if language == "javascript" and re.search(r"Kip:|Kp:[iK]|^K?Ki:|^K?KKi:", s):
            return False
    return True


def foreign(text: str, language: str) -> bool:
    """A statement that begins with another language's keyword and a name."""
    return bool(_STARTS[language].search(text)) if language in _STARTS else False


_STARTS = {g: re.compile(rf"(?m)^[ \t]*(?:{'|'.join(w.split())})[ \t]+[A-Za-z_{{*]") for g, w in _FOREIGN.items()}
_STARTS["java"] = re.compile(_STARTS["java"].pattern + r"|^[ \t]*#[ \t]*include\b", re.M)
