"""Text functions. Patterns are for Java; word edges are ASCII, as in the label grammar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE_L, EDGE_R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
BLANK = r"[\s ﻿]"
MASK32 = 0xFFFFFFFF


def word(pattern: str, ignore_case: bool = True) -> str:
    """The pattern between ASCII word edges."""
    return f"{'(?i)' if ignore_case else ''}{EDGE_L}(?:{pattern}){EDGE_R}"


def present(text: Column) -> Column:
    """Empty text counts as missing."""
    return F.nullif(text, F.lit(""))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANK + "+", " "))


def slug(text: Column, most: int = 48) -> Column:
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, most)


def first_number(text: Column) -> Column:
    """The first number, with commas between thousands, or 0."""
    found = F.replace(F.regexp_extract(text, r"([0-9][0-9,]*(?:\.[0-9]+)?)", 1), F.lit(","), F.lit(""))
    return F.coalesce(found.try_cast("double"), F.lit(0.0))


def first_cents(text: Column) -> Column:
    """The first number in whole hundredths, halves up: 0 without a number or text, null beyond a long."""
    found = F.replace(F.regexp_extract(text, r"([0-9][0-9,]*(?:\.[0-9]+)?)", 1), F.lit(","), F.lit(""))
    number, exact = first_number(text), found.try_cast("decimal(38,6)")
    # From 2**53 hundredths on a double no longer holds each of them.
    return F.when(number < 2.0**53 / 100, F.floor(number * 100 + 0.5)).when(exact <= F.lit("92233720368547758").cast("decimal(38,6)"), F.floor(exact.cast("decimal(24,6)") * 100 + F.lit("0.5").cast("decimal(2,1)"))).cast("long")


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Za-z]", ""))


# Short forms that count as words.
_SHORT_FORM = r"(?i)^(?:ltd|pvt|llp|inc|co|mfg|mfd|mktd|regd|no|st|rd|dist|distt|po|hp|mh|tn|ka|up|wb|ap|ts|gj|rj|mp|dl|hr|pb|uk|jk|blr|hyd|ph|tel|fssai)\.?,?\z"


def looks_like_words(text: Column, share: float = 0.6) -> Column:
    """At least that share of the tokens with a letter, rounded up, are short forms, or three letters or more with a vowel
    and no odd character. False for null and for texts without such tokens."""
    tokens = F.filter(F.split(text, BLANK + "+"), lambda w: w.rlike("[A-Za-z]"))
    good = F.filter(tokens, lambda w: w.rlike(_SHORT_FORM) | ((letters(w) >= 3) & w.rlike("(?i)[aeiouy]") & ~w.rlike(r"[^A-Za-z0-9&()'.,\-/%+]")))
    return F.coalesce((F.size(tokens) > 0) & (F.size(good) >= F.ceil(F.size(tokens) * share)), F.lit(False))


def mask_phone(text: Column) -> Column:
    """All digits but the last four become x."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.concat(F.repeat(F.lit("x"), F.greatest(F.length(digits) - 4, F.lit(0))), F.right(digits, F.lit(4)))


def mask_email(text: Column) -> Column:
    return F.regexp_replace(text, r"^(.).*(@.*)$", "$1***$2")


def initials(name: Column) -> Column:
    parts = F.filter(F.split(F.trim(name), BLANK + "+"), lambda w: w != "")
    last = F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2)
    return F.upper(F.array_join(F.transform(last, lambda w: F.substring(w, 1, 1)), ""))


def padded(number: Column, width: int = 2) -> Column:
    """With leading zeros, never cut."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def fnv1a(text: Column, buckets: int) -> Column:
    """32-bit FNV-1a over the characters' codes, modulo a number of buckets."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    step = lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(MASK32))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), step) % buckets


def normalise(text: Column) -> Column:
    """The classifier's view of a line: lower case, digits as 0, a small set of characters."""
    x = F.regexp_replace(F.lower(text), "₹", " rs ")
    x = F.regexp_replace(F.regexp_replace(x, "[0-9]", "0"), r"[^a-z0-9%./:@&()+\-\s]", " ")
    return collapse(x)


def token_overlap(a: Column, b: Column, longer_than: int = 2) -> Column:
    """Shared tokens over that length, as a share of the smaller token set."""
    own = lambda x: F.array_distinct(F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda w: w != ""))
    shared = F.size(F.filter(F.array_intersect(own(a), own(b)), lambda w: F.length(w) > longer_than))
    return shared / F.greatest(F.lit(1), F.least(F.size(own(a)), F.size(own(b))))


def html_text(html: Column) -> Column:
    """What a page shows: no scripts, styles, comments or tags."""
    bare = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return collapse(F.regexp_replace(bare, "<[^>]*>", " "))


# A quantity as a pack of equal parts, in both orders.
_PACK = r"(?:packs?|n|units?|pcs|pieces|tubes?|sachets?|bars?|pouches?|nos\.?)?"
_MEASURE = r"(kg|gms|gm|g|ml|ltr|l)"
PACK_OF = rf"(?i)([0-9]+)\s*{_PACK}\s*[x×]\s*([0-9]+(?:[.,][0-9]+)?)\s*{_MEASURE}{EDGE_R}"


def pack_total(text: Column) -> Column:
    """count x each of '2 N x 150 g', or null."""
    number = lambda k: F.replace(F.regexp_extract(text, PACK_OF, k), F.lit(","), F.lit(".")).try_cast("double")
    return number(1) * number(2)


def base_amount(amount: Column, unit: Column) -> Column:
    """Grams or millilitres."""
    return F.when(F.lower(unit).isin("kg", "kgs", "l", "ltr", "litre", "litres"), amount * 1000).otherwise(amount)


def repair_rupee(text: Column) -> Column:
    """A lone character that stands where the rupee sign is expected becomes the sign."""
    caption = r"((?i:(?<![A-Za-z0-9_])m\.?\s?r\.?\s?p\.?)\s*[:.\-–—]?\s*)"
    x = F.regexp_replace(text, caption + r"[7RZFTrzft?=](?=\s+[0-9])", "$1₹")
    x = F.regexp_replace(x, caption + r"[RZFTrzft?=](?=[0-9])", "$1₹")
    return F.regexp_replace(x, r"(^|[\s(])[7RZFT]\s+(?=[0-9]{1,5}[.,][0-9]{2}(?![A-Za-z0-9_]))", "$1₹ ")


def date_keys(text: Column, first_year: int = 2015, last_year: int = 2036) -> Column:
    """Sortable keys, year * 12 + month, of all printed month/year pairs, in order."""
    found = lambda k: F.regexp_extract_all(text, F.lit(r"(?<![0-9\-/.])(0?[1-9]|1[0-2])[/\-.](20[0-9]{2}|[0-9]{2})(?![0-9\-/.A-Za-z_])"), F.lit(k))
    year = lambda y: F.when(F.length(y) == 2, y.cast("int") + 2000).otherwise(y.cast("int"))
    keys = F.zip_with(found(1), found(2), lambda m, y: F.when(year(y).between(first_year, last_year), year(y) * 12 + m.cast("int")))
    return F.array_sort(F.filter(keys, lambda k: k.isNotNull()))


def e164(phone: Column, country: str = "91") -> Column:
    """A phone number as + and digits; ten digits get the country's prefix."""
    d = F.regexp_replace(phone, "[^0-9]", "")
    home = (F.length(d) == 10) & ~F.startswith(F.trim(phone), F.lit("+"))
    return F.concat(F.when(home, f"+{country}").otherwise("+"), d)


def ago(now: Column, then: Column) -> Column:
    """How long ago in words, each unit rounded from the one below; from 30 days on the date. Both TIMESTAMP_NTZ."""
    micros = F.timestamp_diff("MICROSECOND", then, now)
    minutes = F.floor(micros / 60e6 + 0.5)
    hours = F.floor(minutes / 60.0 + 0.5)
    days = F.floor(hours / 24.0 + 0.5)
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return F.when(minutes < 1, "just now").when(minutes < 60, text(minutes, "m")).when(hours < 24, text(hours, "h")).when(days < 30, text(days, "d")).otherwise(F.date_format(then, "dd MMM yyyy"))


def _product32(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of numbers of 32 bits, from halves, so that nothing passes 64 bits."""
    return (F.shiftleft((a * F.shiftright(b, 16)).bitwiseAND(F.lit(0xFFFF)), 16) + a * b.bitwiseAND(F.lit(0xFFFF))).bitwiseAND(F.lit(0xFFFFFFFF))


# Starts and factors of the checksum.
CHECKSUM_STARTS = (0xDEADBEEF, 0x41C6CE57)
CHECKSUM_FACTORS = (2654435761, 1597334677)
CHECKSUM_LAST = (2246822507, 3266489909)


def checksum64(text: Column) -> Column:
    """Sixteen hex digits, four times: two sums of 32 bits over the UTF-16 units of a text, each stirred by the other."""
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    pair = lambda p: F.array(F.lit(0xD800) + F.shiftright(p - 0x10000, 10), F.lit(0xDC00) + (p - 0x10000).bitwiseAND(F.lit(0x3FF)))
    units = F.flatten(F.transform(points, lambda p: F.when(p >= 0x10000, pair(p)).otherwise(F.array(p))))
    n = F.size(units).cast("long")
    start = F.struct(*[F.lit(x).cast("long").bitwiseXOR(n).alias(k) for k, x in zip("ab", CHECKSUM_STARTS, strict=True)])
    step = lambda s, c: F.struct(*[_product32(s[k].bitwiseXOR(c), F.lit(x).cast("long")).alias(k) for k, x in zip("ab", CHECKSUM_FACTORS, strict=True)])

    def end(s: Column) -> Column:
        p, q = (F.lit(x).cast("long") for x in CHECKSUM_LAST)
        mixed = lambda x, y: _product32(x.bitwiseXOR(F.shiftright(x, 16)), p).bitwiseXOR(_product32(y.bitwiseXOR(F.shiftright(y, 13)), q))
        out = lambda a, b: F.concat(*[F.lpad(F.lower(F.hex(x)), 8, "0") for x in (b, a)])
        return F.transform(F.array(mixed(s["a"], s["b"])), lambda a: out(a, mixed(s["b"], a)))[0]

    return F.repeat(F.aggregate(units, start, step, end), 4)
