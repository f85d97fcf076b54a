"""Text rules as Column expressions: prices, names, line classes. All work inside higher-order functions.

Patterns are Java's: \\s is made Unicode-aware by (?U) where it matters, and \\z stands for the end of the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce, wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

from ladle.functions.dictionaries import CATEGORY_TITLES, CLEANER_SECTIONS, FOOD_PHRASES, FOOD_WORDS, OCR_CORRECTIONS

#: A word boundary of ASCII words, whatever the Java version: \\b of the fixed patterns below.
BOUNDARY = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def ascii_words(pattern: str) -> str:
    return pattern.replace(r"\b", BOUNDARY)


def edged(pattern: str) -> str:
    """The same pattern, asked faster: its boundaries stand around groups whose alternatives begin and end with ASCII letters or digits."""
    return ascii_words(pattern).replace(f"{BOUNDARY}(", "(?<![A-Za-z0-9_])(").replace(f"){BOUNDARY}", ")(?![A-Za-z0-9_])")


# Patterns of prices.
PRICE_ONLY = r"^[$€£¥]?\s*\d{1,4}(?:[.,]\d{1,2})?[\s.]*\z"
HAS_PRICE = ascii_words(r"[$€£¥]\s*\d|\b\d{1,3}[.,]\d{1,2}\b")
TRAILING_PRICE = r"(?:^|\s)([$€£¥RsSs.]+\s*)?(\d{1,3}(?:[.,]\d{1,2})?|\d{1,3}\s+\d{2})[\s.]*\z"
LEADING_PRICE = r"^[$€£¥Rs.]+\s*(\d{1,3}(?:[.,]\d{1,2})?)\s+"
WORD_PRICE = r"(?i)^[$€£¥Rs.]+\s*(\d{1,3}(?:[.,]\d{1,2})?)\z"
SIZE_VARIANT = r"(Small|Regular|Single|Large|Double|Medium)\s+[$€£¥]?\s*\d"
SIZES_PRICED = r"(Small|Regular|Single|Large|Double|Medium|Kids?)\s+[$€£¥]?\s*\d"
MOST_PRICE = 2000
#: Most lines have none, and so no price; asked before the longer patterns.
DIGIT = "[0-9]"

# Lines that are no dishes (tested on the line in lower case).
NOISE_STARTS = (
    r"(tax|tip|total|subtotal|balance|gratuity|service\s*charge)", r"(phone|tel|fax|email|address|hours|open|closed)",
    r"(order online|delivery|pickup|catering|reservation|booking|gift)", r"(www\.|https?://|@)", r"\d{3,}[.\-\s]?\d{3,}[.\-\s]?\d{4,}\z",
    r"(mon|tue|wed|thu|fri|sat|sun)\b", r"(visa|mastercard|amex|cash|credit|debit|discover)", r"(wifi|password|internet)",
    r"(minimum|minimum delivery|min order)", r"(follow us|find us|connect|like us)", r"(powered by|copyright|all rights|page \d+ (of|/))",
    r"(please|thank|thanks|enjoy|welcome|ask|inquire)", r"hotel\b", r"(menu|menus)\z",
    r"(restaurant|cafe|café|bistro|grill|grille|lounge|bar|truck|house|deli)\z",
)
NOISE_ANYWHERE = (
    r"[a-z0-9][a-z0-9.-]*\.(com|org|net|io|app|me|us|co|uk|ca)(?:/[^\s]*)?(?:\s|\z)", r"\d{3}[.\-\s]\d{3}[.\-\s]\d{4}",
    r"@[a-z0-9.-]+\.[a-z]{2,}", r"(?:follow|find|visit|connect)\s+us", r"(?:order online|delivery|pickup|catering|delivery\s*available)",
    r"(?:pay at|pay upon|counter|cashier|reception)", r"(?:allergen|nutrition|ingredients|contains)",
)
# Noise for the line cleaner (case-insensitive).
SUBTITLE = r"(?i)(est\.?\s*\d{3,4}|since\s*\d{3,4}|(?:19|20)\d{2})"
VENUE = r"(?i)(pub|bistro|grill|grille|caf[eé]|restaurant|kitchen|tavern|eatery|diner|brewery|est\.|establish|house|fine dining|bar\s*&|bar\s*and)"
HOURS = ascii_words(r"(?i)\b(open|closed|daily|monday|tuesday|wednesday|thursday|friday|saturday|sunday|mon|tue|wed|thu|fri|sat|sun|weekdays|weekends)\b")
HOURS_TIME = ascii_words(r"(?i)\b(\d{1,2}(:\d{2})?\s*(am|pm)|(?:19|20)\d{2})\b")
CLEANER_NOISE_DIGITS = (
    r"\b\d{1,5}\s+[A-Za-z]+\s+(st|ave|rd|blvd|ln|dr|way|road|street|boulevard|avenue|place|ct)\.?\b|\b\d{5}(?:-\d{4})?\b",
    r"(?:\(\d{3}\)|\d{3})[\s.-]\d{3}[\s.-]\d{4}\b",
    r"\bpage\s*\d+\s*(of|/|-)\s*\d+\b|^\s*p\.?\s*\d+\s*\z",
)
CLEANER_NOISE = (
    r"(uber eats|doordash|grubhub|order online|online order|delivery|take[- ]?out|curbside|pick[- ]?up|reservation|book a table|to[- ]?go|gift card|gift certificate)",
    r"(all rights reserved|may contain|allergen|please inform|for allergy|gluten[- ]free option|consuming raw|undercooked|copyright)",
    r"(@[a-z0-9_.]+|facebook\.com|instagram\.com|twitter\.com|tiktok\.com|www\.\S+|https?://\S+)",
    r"[©®™]|copyright\s*\d{0,4}",
    r"^menu\z",
)
DISH_PREFIX = ascii_words(r"(?i)^(extra|serves?|for|with|choice|add|plus|and|side|to|feeds?|serving|one|two|three|four|half|full|large|small|medium|regular|double|kids?|choose|ask|please)\b")
DESCRIPTION_START = ascii_words(r"^(with|in|on|served|topped|drizzled|accompanied|comes|available|choice|side|and|plus|add)\b")
DESCRIPTION_CODE = ascii_words(r"\b(gf|v|vg|df|contains|allergen|nut)\b")
DESCRIPTION_WORDS = ("with", "fresh", "sautéed", "roasted", "grilled", "baked", "served", "topped", "drizzled", "alongside", "accompanied", "choice", "side", "in", "on", "and", "plus")
GENERIC_WORDS = ("the", "and", "with", "for", "our", "all", "your", "from")
# Category by a word of the name, in order.
CATEGORY_BY_WORD = (
    ("pasta", "pizza|pasta|spaghetti|lasagna|ravioli|penne|fettuccine"),
    ("salad", "salad|caesar|greek|garden"),
    ("soup", "soup|chowder|bisque|stew"),
    ("sandwich", "burger|sandwich|wrap|sub|hoagie"),
    ("entree", "steak|rib|chop|wings|tenders"),
    ("dessert", "cake|pie|ice cream|sundae|tiramisu|pudding"),
    ("drink", "water|soda|juice|coffee|tea|milk|shake|smoothie|beer|wine|cocktail"),
)


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), with c computed once however often f uses it; keeps plans from growing with each nested rule."""
    return F.get(F.transform(F.array(c), lambda v: f(v)), F.lit(0))


def bound(f: Callable[..., Column]) -> Callable[..., Column]:
    """Binds the first argument of a rule with let."""

    @wraps(f)
    def rule(c: Column, *args, **kwargs) -> Column:
        return let(c, lambda v: f(v, *args, **kwargs))

    return rule


#: The characters of (?U)\\s, less the space. A plain class, as (?U) asks for the type of every character.
_OTHER_SPACES = "\t\n\x0b\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_OTHERS = "\t\n\x0b\f\r\x85\xa0\u1680\u2000-\u200a\u2028-\u2029\u202f\u205f\u3000"
#: What is no space but white, and what is not one space: runs, and other white space. Printable ASCII is passed by at once.
_OTHER_SPACE = f"(?=[^ -~])[{_OTHERS}]"
_WIDE_SPACE = f" [ {_OTHERS}]+|{_OTHER_SPACE}[ {_OTHERS}]*"


def squeeze(c: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, _WIDE_SPACE, " "))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(f" {_OTHER_SPACES}"))


def pieces(c: Column) -> Column:
    """Split at white space, with empty words at the ends."""
    # split compiles its pattern for every value, but not one of a single character
    return F.split(F.regexp_replace(c, _WIDE_SPACE, " "), " ")


def words(c: Column) -> Column:
    """Split at white space, without empty words."""
    return F.filter(F.split(F.regexp_replace(c, _OTHER_SPACE, " "), " "), lambda w: w != "")


def among(c: Column, values: Sequence[str], buckets: int = 64) -> Column:
    """Whether c is one of the values, none of which is empty or holds a comma.

    The values are filed by first character and length, so only a few are compared. One literal, so plans stay small with long lists.
    """
    filed: list[list[str]] = [[] for _ in range(buckets)]
    for v in values:
        filed[(ord(v[0]) + 7 * len(v)) % buckets].append(v)
    # an empty list would hold "": it gets a text that is filed elsewhere
    lists = F.array(*(F.lit(",".join(x or ["\0" if k != 7 % buckets else "\0\0"])) for k, x in enumerate(filed)))
    return F.find_in_set(c, F.get(lists, F.pmod(F.ascii(c) + F.length(c) * 7, F.lit(buckets)))) > 0


def is_upper(c: Column) -> Column:
    """Whether a text is the same in upper case; asked of those without a-z alone, as most have one of them."""
    return ~c.rlike("[a-z]") & (c == F.upper(c))


def _any(c: Column, patterns: Sequence[str], prefix: str = "") -> Column:
    """One alternation instead of a chain of tests."""
    return c.rlike(ascii_words(prefix + "(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"))


@bound
def price_value(raw: Column) -> Column:
    """The number of a price text: currency signs and thousands commas go, 12,50 is a decimal comma, 1250 is 12.50."""
    s = F.regexp_replace(F.regexp_replace(strip(raw), r"(?i)^[$€£¥Rs.\s]+", ""), r"(?i)[$€£¥.\s]+\z", "")
    s = F.regexp_replace(F.regexp_replace(s, r"^(\d{1,3}),(\d{1,2})\z", "$1.$2"), r"[^\d.]", "")

    def value(s: Column) -> Column:
        whole = s.try_cast("double")
        cents = F.floor(whole / 100) + F.round(F.pmod(whole, F.lit(100.0)) / 100, 2)
        no_point = (F.length(s) >= 4) & ~F.contains(s, F.lit("."))
        first = F.regexp_extract(s, r"^(\d*\.?\d*)", 1).try_cast("double")
        return F.when(s == "", None).when(no_point & (whole < 1000), whole).when(no_point & (F.floor(whole / 100) < 200), cents).when(no_point, whole).otherwise(first)

    return let(s, value)


@bound
def find_price(text: Column) -> Column:
    """struct(price, raw, position) of a price at the end of a text, else at its start; null if there is none."""
    t = strip(text)
    tail, head = F.regexp_extract(t, TRAILING_PRICE, 0), F.regexp_extract(t, LEADING_PRICE, 0)

    def found(raw: Column, position: str) -> Column:
        made = lambda r: let(price_value(r), lambda p: F.when((r != "") & p.isNotNull() & (p < MOST_PRICE), F.struct(p.alias("price"), strip(r).alias("raw"), F.lit(position).alias("position"))))
        return let(raw, made)

    return F.when(text.rlike(DIGIT), F.coalesce(found(tail, "trailing"), found(head, "left_side")))


def price_in_word(word: Column) -> Column:
    """The price of a whole token that has a currency sign."""
    return F.when(word.rlike(WORD_PRICE), let(price_value(word), lambda p: F.when(p < MOST_PRICE, p)))


def count_price_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(HAS_PRICE)))


def without_price(line: Column, price: Column) -> Column:
    """A line without the price that find_price found in it."""

    def cut(x: Column, p: Column) -> Column:
        end = F.length(x) - F.length(F.call_function("substring_index", x, p["raw"], F.lit(-1))) - F.length(p["raw"])
        head = F.regexp_replace(x, r"^[$€£¥Rs.]+\s*\d+(?:[.,]\d+)?\s+", "")
        return F.when(p["position"] == "trailing", strip(F.substring(x, F.lit(1), end))).when(p["position"] == "left_side", strip(head)).otherwise(x)

    return let(line, lambda x: let(price, lambda p: cut(x, p)))


# Rewrites of a dish name whose white space is squeezed, in order; ends are trimmed after each. The marked ones may
# touch texts of letters, spaces and PLAIN signs alone, the others need another character.
PLAIN = r"[^\p{L} .,'&]"
NAME_REWRITES = (
    (False, r"^[★☆⭐●◆▪▸►▹→•¶※✓✗✘✔✖✝✙✦✧⬟⬡⌾⭑✪✫✬✭✮✯✰✱✲✳✴✵✶✷✸✹✺✻✼✽✾✿❀]+", ""),
    (True, r"(?i)^(NEW!?|CHEF'?S?\s*SPECIAL|SIGNATURE|HOTEL|RESTAURANT|CAFE|CAFÉ|BAR|LOUNGE|GRILL|GRILLE|BISTRO)\s+", ""),
    (False, r"^\s*\[.*?\]\s*", ""), (False, r"\s*\[.*?\]\s*\z", ""), (False, r"^\s*\(.*?\)\s*", ""), (False, r"\s*\(.*?\)\s*\z", ""),
    (False, r"^\d+[.)\s]+", ""), (False, r"^[$€£¥RsSs.]*\s*\d{1,3}(?:[.,]\s?\d{1,2}|\s+\d{2})\s+", ""), (True, r"[;,]+\z", ""), (False, r" *_[_ ]*", " "),
    (False, r"^[-–—]+", ""), (False, r"[-–—]+\z", ""), (False, r" *[-–—]{2,}(?: *[-–—]{2,})* *", " "), (False, r"\s+[-–—]+\s+", " "), (False, r"(\d+)\s*/\s*(\d+)", "$1/$2"),
    (True, r" *[*>{<%|`~^\\(){}\[\].][*>{<%|`~^\\(){}\[\]. ]*", " "),
    (True, r"(?i)\s+(NEW|SPICY|HOT|MILD|CHEF'?S?\s*SPECIAL|SIGNATURE)\z", ""),
    (True, r"(?<=.{2})\s+S\z", ""), (True, r"(?i)\s+(?:V|VG|GF|DF|N)\s*\z", ""),
)


@bound
def clean_name(raw: Column) -> Column:
    """A dish name without bullets, brackets, numbering, prices, stray signs and short closing tokens; raw if too little is left."""

    def rewritten(c: Column) -> Column:
        chain = lambda table: reduce(lambda x, r: F.trim(F.regexp_replace(x, r[1], r[2])), table, c)
        return F.when(c.rlike(PLAIN), chain(NAME_REWRITES)).otherwise(chain([r for r in NAME_REWRITES if r[0]]))

    def cut(name: Column) -> Column:
        # closing tokens of one or two characters go while more than three characters are there
        parts = F.split(name, " ")
        cut = F.aggregate(parts, F.size(parts), lambda n, _: F.when((n > 1) & (F.length(F.element_at(parts, n)) <= 2) & (F.length(F.array_join(F.slice(parts, F.lit(1), n), " ")) > 3), n - 1).otherwise(n))
        return let(F.array_join(F.slice(parts, F.lit(1), cut), " "), lambda short: F.when(F.length(short) < 3, name).otherwise(short))

    trimmed = lambda name: F.when(name.rlike(r" [^ ]{1,2}\z"), cut(name)).otherwise(name)
    return let(let(let(squeeze(raw), rewritten), trimmed), lambda n: F.when((F.length(n) < 3) | ~n.rlike(r"\p{L}"), strip(raw)).otherwise(n))


def _alternatives(patterns: Sequence[str]) -> list[str]:
    """The alternatives of patterns, apart, where no parentheses hold them, or one pair holds them all."""
    inside = [re.fullmatch(r"\((?:\?:)?([^()]*)\)|([^()]*)", p) for p in patterns]
    return [a for p, m in zip(patterns, inside, strict=True) for a in ((m[1] or m[2]).split("|") if m else [p])]


def literal(pattern: str) -> str:
    """The longest text that stands in every match of a pattern, in lower case; "" if groups, classes and repeats leave none."""
    pattern = re.sub(r"\([^()]*\)", "[]", pattern.replace(r"\b", ""))
    # what may be missing, and what stands for several characters, cuts the text
    pattern = re.sub(r"(?:\[[^\]]*\]|\\[a-zA-Z]|[^\\\[\]])(?:[?*]|\{\d+(?:,\d*)?\})|\[[^\]]*\]|\\[a-zA-Z]|[+^$]", "\0", pattern)
    return max(re.sub(r"\\(.)", r"\1", pattern).lower().split("\0"), key=len)


def _any_held(c: Column, low: Column, patterns: Sequence[str], prefix: str = "") -> Column:
    """_any, asked of few texts: those (low: in lower case) that hold what one of the patterns cannot do without. One or two letters,
    which many texts hold, tell nothing: such patterns are asked of all."""
    rare = lambda p: len(literal(p)) >= 3 or literal(p) == "@"
    bare, needed = [p for p in patterns if not rare(p)], sorted({literal(p) for p in patterns if rare(p)})
    held = reduce(lambda a, b: a | b, (F.contains(low, F.lit(x)) for x in needed))
    found = held & _any(c, _by_first_letter([p for p in patterns if rare(p)]), prefix)
    return _any(c, _by_first_letter(bare), prefix) | found if bare else found


def _by_first_letter(patterns: Sequence[str]) -> list[str]:
    """The same alternatives, those that begin with one letter as one: a text is asked for some 20 letters a place, not for all patterns."""
    filed: dict[str, list[str]] = {}
    for p in patterns:
        plain = len(p) > 1 and p[0].isascii() and p[0].isalpha() and p[1] not in "?*+{" and "|" not in p
        filed.setdefault(p[0] if plain else "", []).append(p[1:] if plain else f"(?:{p})")
    return [f"{letter}(?:{'|'.join(rest)})" for letter, rest in filed.items()]


@bound
def correct_ocr(c: Column, table: Sequence[tuple[str, str]] = OCR_CORRECTIONS) -> Column:
    """Misread words corrected, in the table's order. The whole table is tried only on texts that any entry touches."""
    fixed = reduce(lambda x, r: F.regexp_replace(x, ascii_words(f"(?i){r[0]}"), r[1]), table, c)
    return F.when(let(F.lower(c), lambda low: _any_held(c, low, [p for p, _ in table], "(?i)")), fixed).otherwise(c)


def is_food(word: Column, food: Sequence[str] = FOOD_WORDS, phrases: Sequence[str] = FOOD_PHRASES) -> Column:
    """Whether a text as a whole is a food word or phrase."""
    return _is_food(F.lower(word), food, phrases)


def _is_food(w: Column, food: Sequence[str] = FOOD_WORDS, phrases: Sequence[str] = FOOD_PHRASES) -> Column:
    """is_food of a text in lower case."""
    return among(w, food) | w.rlike("(?U)^(?:" + "|".join(phrases) + r")\z")


def food_count(c: Column, food: Sequence[str] = FOOD_WORDS, phrases: Sequence[str] = FOOD_PHRASES) -> Column:
    return F.size(F.filter(words(F.lower(c)), lambda w: _is_food(w, food, phrases)))


@bound
def is_section(text: Column, titles: Sequence[str] = CATEGORY_TITLES) -> Column:
    """Whether a lower-case text is a section title (also with one final s less)."""
    return among(text, titles) | (F.endswith(text, F.lit("s")) & among(F.substring(text, F.lit(1), F.length(text) - 1), titles))


@bound
def is_noise(line: Column) -> Column:
    return let(strip(line), lambda t: let(F.lower(t), lambda low: _noise(t, low)))


def _noise(t: Column, low: Column) -> Column:
    digits = F.when(t.rlike(DIGIT), F.length(F.regexp_replace(t, r"[^\d]+", ""))).otherwise(0)
    www = low.rlike("^www[a-z]") & ~F.contains(t, F.lit("."))
    site, phone, mail, *others = NOISE_ANYWHERE
    marked = (F.contains(low, F.lit(".")) & _any(low, [site])) | (low.rlike(DIGIT) & _any(low, [phone])) | (F.contains(low, F.lit("@")) & _any(low, [mail]))
    return (F.length(t) < 3) | _any(low, NOISE_STARTS, "^") | marked | _any_held(low, low, _alternatives(others)) | www | ((F.length(t) <= 3) & t.rlike(r"^[A-Z][a-z]*\z")) | t.rlike(r"^[^\p{L}\p{N}]+\z") | (digits * 2 > F.length(t))


@bound
def is_header(line: Column, has_price: Column, centred: Column | None = None) -> Column:
    """Whether an unpriced line is a section title."""
    centred = F.lit(False) if centred is None else centred
    # only what is short enough is taken apart
    return let(strip(line), lambda t: ~has_price & F.length(t).between(2, 80) & let(F.lower(t), lambda low: let(words(low), lambda w: _header(t, low, w, centred))))


def _header(t: Column, low: Column, w: Column, centred: Column) -> Column:
    ends = among(F.get(w, F.lit(0)), CATEGORY_TITLES) | among(F.get(w, F.size(w) - 1), CATEGORY_TITLES)
    bare = ~F.exists(w, lambda x: _is_food(x))
    looks = ends | ((F.size(w) <= 3) & is_upper(t) & bare) | (centred & (F.size(w) <= 4) & ~low.rlike(r"\d") & t.rlike("^[A-Z]") & bare)
    priced = low.rlike(DIGIT) & low.rlike(ascii_words(r"[$€£¥]\s*\d|\b\d+[.,]\d"))
    return is_section(low) | (looks & ~priced)


@bound
def header_category(line: Column) -> Column:
    """The first word of a title of three to five section words, else the title."""
    w = words(line)
    return F.when(F.size(w).between(3, 5) & F.forall(w, lambda x: among(F.lower(x), CATEGORY_TITLES)), F.get(w, F.lit(0))).otherwise(strip(line))


@bound
def is_description(line: Column) -> Column:

    def marked(w: Column) -> Column:
        return (F.size(w) <= 10) & (F.size(F.filter(w, lambda x: x.isin(*DESCRIPTION_WORDS))) >= 2)

    return let(F.lower(strip(line)), lambda t: (F.length(t) > 100) | t.rlike(DESCRIPTION_START) | t.rlike(edged(DESCRIPTION_CODE)) | let(words(t), marked))


@bound
def real_words(name: Column, letters: str = r"\p{L}") -> Column:
    """Whether at least 60 % of the tokens with a letter have three in a row."""

    def test(w: Column) -> Column:
        real = F.size(F.filter(w, lambda x: x.rlike(f"(?:{letters}){{3,}}")))
        return (F.size(w) > 0) & (real >= F.greatest(F.lit(1), F.ceil(F.size(w) * 0.6)))

    return let(F.filter(words(name), lambda x: x.rlike(letters)), test)


@bound
def category_of(name: Column) -> Column:
    low = F.lower(name)
    out = F
    for category, alternatives in CATEGORY_BY_WORD:
        out = out.when(low.rlike(edged(rf"\b({alternatives})\b")), category)
    known = _by_first_letter([w for _, alternatives in CATEGORY_BY_WORD for w in alternatives.split("|")])
    return F.when(low.rlike(edged(rf"\b({'|'.join(known)})\b")), out).otherwise("other")


def confidence(has_price: Column, name: Column, category: Column, centred: Column, all_caps: Column, layout: Column) -> Column:
    """How likely a name is a dish, 0 to 1."""
    return let(name, lambda x: let(pieces(F.lower(x)), lambda w: _confidence(has_price, x, w, category, centred, all_caps, layout)))


def _confidence(has_price: Column, name: Column, w: Column, category: Column, centred: Column, all_caps: Column, layout: Column) -> Column:
    n, food = F.size(w), F.size(F.filter(w, lambda x: _is_food(x)))
    generic = F.size(F.filter(w, lambda x: x.isin(*GENERIC_WORDS)))

    def plus(test: Column, amount: float) -> Column:
        return F.when(test, amount).otherwise(0.0)

    score = plus(has_price, 0.4) + F.least(food * 0.15, F.lit(0.35)) + plus(F.coalesce(category, F.lit("")) != "", 0.15)
    score = score + F.when(n.between(2, 6), 0.1).when(n > 8, -0.15).otherwise(0.0) + plus(all_caps & ~has_price, -0.15)
    score = score + plus(name.rlike(r"\d") & ~name.rlike(r"\d+\.\d{2}"), -0.1) + plus(F.length(name) < 5, -0.1) + plus(generic > n * 0.5, -0.2)
    score = score + plus(centred, -0.1) + plus((layout == "fastfood") & ~has_price, -0.1) + plus((layout == "descriptive") & (n <= 3), 0.1)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def table_entry(name: Column, category: Column, layout: Column) -> Column:
    """Whether a name without a price is a dish, by its category and the menu's layout."""
    t = F.lower(strip(name))
    w = words(t)
    food = F.size(F.filter(w, lambda x: is_food(x)))
    loose = F.lower(F.coalesce(category, F.lit(""))).rlike("pizza|dessert")
    return ((F.size(w) >= 2) | is_food(t)) & F.when(loose, (food >= 1) | (F.size(w) >= 2)).otherwise(food >= 1)


@bound
def line_kind(line: Column, sections: Sequence[str] = ()) -> Column:
    """noise, price, header or dish, as the line cleaner sees it."""
    return let(strip(line), lambda t: _kind(t, F.lower(t), sections or CLEANER_SECTIONS))


def _kind(t: Column, low: Column, sections: Sequence[str]) -> Column:
    known = (F.length(t) <= max(map(len, sections)) + 1) & (low.isin(*sections) | F.regexp_replace(low, r"s\z", "").isin(*sections))
    dated = (t.rlike(SUBTITLE) & t.rlike(VENUE)) | (t.rlike(HOURS_TIME) & t.rlike(HOURS)) | _any(t, CLEANER_NOISE_DIGITS, "(?i)")
    noise = (t.rlike(DIGIT) & dated) | _any_held(t, low, _alternatives(CLEANER_NOISE), "(?i)")
    return F.when(t.rlike(r"^[\W_\s]*\z"), "noise").when(t.rlike(PRICE_ONLY), "price").when(known | all_caps(t), "header").when(noise, "noise").otherwise("dish")


@bound
def all_caps(text: Column) -> Column:
    """At least three letters, none in lower case."""
    return is_upper(text) & (F.length(F.regexp_replace(text, "[^a-zA-Z]+", "")) >= 3)


@bound
def attachable(line: Column) -> Column:
    """Whether a dish line may take the price that stands alone on the next line."""
    t = strip(line)
    return (F.length(t) >= 3) & t.rlike("[a-zA-Z]{3,}") & ~t.rlike(HAS_PRICE) & ~all_caps(t)


def norm_name(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def strip_food_description(c: Column) -> Column:
    """A search term: no parentheses, cooking words, connectives or signs; 50 characters at most."""
    c = F.regexp_replace(c, r"\s*\(.*?\)\s*", " ")
    c = F.regexp_replace(c, r"(?i)\b(grilled|fried|roasted|baked|steamed|sautéed|sauteed|pan[-\s]fried|deep[-\s]fried|stir[-\s]fried|with|in|and|on|of|style)\b", "")
    return F.substring(strip(F.regexp_replace(c, r"[^a-zA-Z0-9\s]", "")), 1, 50)


def origin_of(c: Column) -> Column:
    """What follows from, originating in, native to or popular in, up to a comma or full stop; "" if there is none."""
    return strip(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?:from|originating in|native to|popular in)\s+([A-Za-z][A-Za-z\s]+?)(?:\.|,|\z)", 1))


@bound
def fenced_json(c: Column, schema: str, most: int = 300) -> Column:
    """struct(value, text): the JSON in a Markdown code fence or plain; text is the start of what cannot be parsed."""
    body = strip(F.regexp_replace(c, r"(?i)```(?:json)?", ""))
    value = F.from_json(body, schema)
    ok = F.try_parse_json(body).isNotNull()
    return F.struct(F.when(ok, value).alias("value"), F.when(~F.coalesce(ok, F.lit(False)), F.substring(c, 1, most)).alias("text"))


# What users read instead of errors, first pattern that fits.
ERROR_MESSAGES = (
    (r"429|rate.?limit|quota|free-models-per-day", "Service is busy. Please try again in a minute."),
    (r"401|unauthorized|invalid.*key|api.?key", "Authentication failed. Please try again later."),
    (r"timeout|timed.?out", "Request timed out. Please try again."),
    (r"fetch.*failed|ECONNREFUSED|ENOTFOUND|ETIMEDOUT", "Connection failed. Please try again."),
    (r"openrouter|gemini|groq|provider", "AI service unavailable. Please try again."),
    (r"image.*search|search.*image", "Image search failed. Please try again."),
)
TRANSIENT = r"(?i)timeout|ECONNRESET|ETIMEDOUT|ECONNREFUSED|ENOTFOUND|\b429\b|rate limit|quota|5\d\d|internal|unavailable|overloaded|busy"


def error_message(c: Column, table: Sequence[tuple[str, str]] = ERROR_MESSAGES) -> Column:
    out = F
    for pattern, message in table:
        out = out.when(c.rlike(f"(?i){pattern}"), message)
    return out.otherwise("Something went wrong. Please try again.")


def is_transient(c: Column) -> Column:
    """Errors that are worth another try."""
    return F.coalesce(c.rlike(TRANSIENT), F.lit(False))


def valid_email(c: Column) -> Column:
    return c.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+\z")


def valid_id(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9_-]{1,64}\z")


# Languages that texts are translated to.
LANGUAGES = ("English", "Urdu", "Arabic", "Chinese", "French", "Spanish", "German", "Japanese")


def language_of(c: Column) -> Column:
    """The language's name whatever its case, null if it is unknown."""
    name = F.initcap(strip(c))
    return F.when(name.isin(*LANGUAGES), name)


def content_hash(c: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(c, 256), 1, n)
