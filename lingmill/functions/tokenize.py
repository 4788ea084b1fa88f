"""The social-media tokenizer: one regular expression that Java, RE2 and Python read alike, and n-grams over its tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_W = r"[\p{L}\p{N}_]"
_INNER = r"[\p{L}\p{N}_'-]"
_EYES, _NOSE, _MOUTH = ":;=8", r"[o*'-]?", r"[()\[\]{}dpx/\\|:@]"
_EYE_LEFT, _EYE_RIGHT = r"[o~^*+>-]", r"[o~^*+<-]"
_DOMAINS = "am be cc co com edu fm gd gl gov gs im info jp kr ly me net nl org pr sg to us ws"
#: Longer names come first, as "co" begins "com".
_TLD = "|".join(sorted(_DOMAINS.split(), key=len, reverse=True))
#: In order: the first alternative that matches at a place wins.
ALTERNATIVES = [
    r"(?:\+?[01][\s.-]*)?(?:\(?\p{Nd}{3}[\s.)-]*)?\p{Nd}{3}[\s.-]*\p{Nd}{4}",  # phone numbers
    # emoticons: to the right, to the left, hearts, faces from the front
    "|".join([f"[<>]?[{_EYES}>]{_NOSE}{_MOUTH}", f"{_MOUTH}{_NOSE}[{_EYES}<][<>]?", r"<[/\\]?3", rf"\(?\(?#?{_EYE_LEFT}[o_.|,]{_EYE_RIGHT}[#;]?\)?\)?"]),
    rf"(?:https?://)?(?:[\p{{L}}\p{{N}}_-]+\.)+(?:{_TLD})(?:/[\s\x08$])?",  # web addresses, without what follows the domain
    r"https?://",
    rf"\[{_W}+\]",  # commands
    rf"/{_W}+\?(?:;?{_W}+={_W}+)+",  # the end of a GET request
    r"<[^>]+=[^>]+>|<[^>]+\s/>|<[^>\s]+>?|<?[^<\s]+>",  # tags, and whatever ends like one
    rf"@{_W}+",
    rf"#+{_W}+{_INNER}*{_W}+",
    rf"\[[^\]]{_W}+:?{_W}+[^\]]\]",  # named entities
    rf"{_W}{_INNER}+{_W}",  # words with marks inside
    r"[+-]?\p{Nd}+[,/.:-]\p{Nd}+[+-]?",
    rf"{_W}+",
    r"\.[\s.]*\.",  # dots, with or without space
    r"\S",
]
TOKEN = "(?i)" + "|".join(f"(?:{a})" for a in ALTERNATIVES)
EMOTICON = "(?i)" + ALTERNATIVES[1]
#: The same tokens, in group 1, for Java: white space is passed over, and what needs no trial of every alternative comes
#: first: letters (but for "ooo", a face) and marks before white space, which no other alternative can begin or end otherwise.
FAST = r"(?:(?<!\s)\s++)?((?!(?i:ooo))\p{L}++(?=[,.!?]?(?:\s|\z))|[,!?](?=\s|\z)|\.(?=\s++[^\s.]|\s*+\z)|" + TOKEN + ")"


def tokenize(text: Column, keep_emoticon_case: bool = True) -> Column:
    """Tokens, in lower case unless there is an emoticon in them."""
    tokens = F.regexp_extract_all(text, F.lit(FAST), F.lit(1))
    # most are in lower case already, and aren't searched for emoticons
    return F.transform(tokens, lambda t: F.when((F.lower(t) == t) | t.rlike(EMOTICON), t).otherwise(F.lower(t)) if keep_emoticon_case else F.lower(t))


def feature_length(n: int) -> int:
    """Characters that an n-gram keeps."""
    return min((36 - (n - 1)) * n, 255)


def ngrams(tokens: Column, n: int, sep: str = " ", length: int | None = None) -> Column:
    """All runs of n elements, joined."""
    limit = feature_length(n) if length is None else length
    if n == 1:
        return F.transform(tokens, lambda t: F.substring(t, 1, limit))
    first = F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(0)))
    runs = F.transform(first, lambda t, i: F.substring(F.concat_ws(sep, t, *[F.get(tokens, i + k) for k in range(1, n)]), 1, limit))
    return F.when(F.size(tokens) >= n, runs).otherwise(F.array().cast("array<string>"))


def characters(text: Column) -> Column:
    """The characters of a text; a space is the empty string."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.trim(c))
