"""Plate texts as Column expressions (no Python UDF)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats of plates, look-alike characters and scores that results depend on.
FORMATS = r"[A-Z]{3}\d{3,4}|[A-Z]{3}-\d{3}|[A-Z]{2,3}\d{3}|[A-Z]{3}\d{2,3}|[A-Z]{2,3}-\d{2,3}|[A-Z]{1,3}-\d{3}|[A-Z]{3}-\d{2,3}|\d{2,3}[A-Z]{3}\d{2}|\d{3}-[A-Z]{3}|[A-Z]{2}\d{3}[A-Z]{2}|[A-Z]{1,2}\d{4,5}|\d{4,7}|[A-Z]{1,3}\d{2,3}"
SHAPES = [
    "LLNNNN", "LLNNNL", "LNNNNLL", "NNNNLL", "LNNNNN", "LLLNNN", "NNLLNN", "LLNNN", "LNNNN", "NNNLL", "LNNNL", "LLNNL", "LNNLL", "LLLNN", "NNNNNL", "LNNLN",
]
CONFUSABLE = ("ODQILJZEASGCTBPR", "0001112345667899")
EQUIVALENT = ["0OQD", "1IL", "2Z", "5S", "8B", "6G", "VUW", "4A", "9g", "YV"]
SWAPPED = ["0O", "1I", "5S", "8B", "2Z"]
DIGIT_TO_LETTER = ("0123456789", "OIZEASGTBP")
LETTER_TO_DIGIT = ("ODCQILTZSGEAJYBPR", "00001112563417899")
LEAD_LETTERS = ("0128564", "OIZBSGA")
TAIL_DIGITS = ("OIZBSGATQD", "0128564700")
SWAP_LETTERS = ("012584", "OIZSBA")
SWAP_DIGITS = ("OIZSBA", "012584")
REGIONS = ["ES", "CL"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _size(x: Column) -> Column:
    return F.length(x)


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _once(x: Column, then) -> Column:
    """``then(x)`` with ``x`` evaluated once, however often ``then`` names it: Spark puts a
    named expression in every place that it is named in."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def _at(x: Column, i) -> Column:
    """Character at ``i`` from 0; empty beyond the ends."""
    i = i if isinstance(i, Column) else F.lit(i)
    return F.when(i < 0, "").otherwise(F.substring(x, i + 1, F.lit(1)))


def chars(x) -> Column:
    return F.filter(F.split(_c(x), ""), lambda c: c != "")


def clean_plate(col, keep_hyphen: bool = False) -> Column:
    return F.regexp_replace(F.upper(_c(col)), "[^A-Z0-9-]" if keep_hyphen else "[^A-Z0-9]", "")


def complies_7(col) -> Column:
    return _c(col).rlike("^[A-Z013456]{2}[0-9OIJAGS]{2}[A-Z013456]{3}$")


def format_7(col) -> Column:
    t = _c(col)
    letters = lambda x: F.translate(x, "013465", "OIJAGS")
    return F.concat(letters(F.substring(t, 1, 2)), F.translate(F.substring(t, 3, 2), "OIJAGS", "013465"), letters(F.substring(t, 5, 3)))


def valid_format(col) -> Column:
    t = _c(col)
    return F.coalesce((_size(t) >= 5) & (t.rlike(f"^(?:{FORMATS})$") | t.rlike(r"[A-Z]{2,3}.*\d{2,3}")), F.lit(False))


def pattern_key(col) -> Column:
    """Letters to L, digits to N, hyphens kept, the rest dropped."""
    t = F.regexp_replace(F.regexp_replace(_c(col), r"[^\p{L}0-9-]", ""), r"\p{L}", "L")
    return F.regexp_replace(t, "[0-9]", "N")


def valid_plate(col, night: bool = False, known: list[str] = (), prefixes: list[str] = ()) -> Column:
    """Raw text of four characters at least; length, letters and digits; then a known plate,
    a known shape or a known prefix; nights are laxer."""
    t = clean_plate(col)
    letters, digits = _size(F.regexp_replace(t, "[^A-Z]", "")), _size(F.regexp_replace(t, "[^0-9]", ""))
    base = (_size(_c(col)) >= 4) & _size(t).between(*((3, 9) if night else (4, 8))) & (letters >= 1) & (digits >= (1 if night else 2))
    if night:
        like = [positional_matches(t, F.lit(k)) >= F.least(F.lit(4), _size(t), F.lit(len(k))) for k in known]
        like += [t.rlike(r"^[A-Z]{1,2}\d{2,4}"), t.rlike(r"^\d{3,4}[A-Z]{1,2}")]
    else:
        like = [t.isin(*known)] if known else []
    like += [pattern_key(t).isin(*SHAPES), *(t.startswith(p) for p in prefixes)]
    return F.coalesce(base & reduce(lambda a, b: a | b, like), F.lit(False))


def _similar(a: Column, b: Column) -> Column:
    most = F.greatest(_size(a), _size(b))
    return 1 - F.levenshtein(a, b) / F.nullif(most, F.lit(0))


def pattern_similarity(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.when((_size(a) > 0) & (_size(b) > 0), _similar(a, b)).otherwise(0.0)


def pattern_coherence(col) -> Column:
    t = _c(col)
    n, letters, digits = _size(t), _size(F.regexp_replace(t, r"[^\p{L}]", "")), _size(F.regexp_replace(t, "[^0-9]", ""))
    both = (letters > 0) & (digits > 0)
    order = F.when(both & t.rlike(r"^[^0-9]*$|^[^0-9]*\p{L}[^0-9]*[0-9][^\p{L}]*$"), 0.3).when(both & t.rlike(r"^[^\p{L}]*[0-9][^\p{L}]*\p{L}[^0-9]*$"), 0.2).otherwise(0.0)
    length = F.when(n.between(6, 7), 0.2).when(n.between(5, 8), 0.1).otherwise(0.0)
    balance = F.when(both & (F.abs(letters - digits) <= 2), 0.2).otherwise(0.0)
    ratio = F.when(both & (letters == 3) & (digits == 3), 0.3).when(both & (letters == 2) & (digits >= 3), 0.2).when(both & (letters == 1) & (digits >= 4), 0.1).otherwise(0.0)
    return F.when(n >= 5, F.least(F.lit(1.0), order + length + balance + ratio)).otherwise(0.0)


def format_break(col) -> Column:
    t = _c(col)
    n = _size(t)
    change = F.regexp_instr(t, F.lit(r"(?<=\p{L})[0-9]|(?<=[0-9])\p{L}"))
    letters = _size(F.regexp_replace(t, r"[^\p{L}]", ""))
    digit = F.regexp_instr(t, F.lit("[0-9]"))
    mixed = (letters > 0) & (letters < n)
    return (
        F.when(n == 0, 0).when(change > 0, change - 1).when(mixed & (letters <= F.floor(n / 2)), letters)
        .when(mixed & (digit > 0), digit - 1).otherwise(F.floor(n / 2)).cast("int")
    )


def context_correct(col, density=0.0) -> Column:
    """Letters before the break and digits after it, by look-alikes; a leading A for texts
    of low density that start with three digits; a hyphen where letters end, unless the
    result has a known format."""
    density = density if isinstance(density, Column) else F.lit(density)
    is_letter = lambda c: c.rlike(r"^\p{L}$")
    is_digit = lambda c: c.rlike("^[0-9]$")

    def letters(t, cut, special):
        def one(c, i):
            before = F.when(i > 0, F.substring(t, i, F.lit(1))).otherwise("")
            lead, tail = F.translate(c, *LEAD_LETTERS), F.translate(c, *TAIL_DIGITS)
            keep = i.isin(0, 4)
            as_special = F.when(keep & is_digit(c), lead).when(~keep & is_letter(c), tail).otherwise(c)
            plain = F.when((i < cut) & is_digit(c) & ~is_digit(before), lead).when((i >= cut) & is_letter(c) & ~is_letter(before), tail).otherwise(c)
            return F.when(special, as_special).otherwise(plain)

        return F.array_join(F.transform(chars(t), one), "")

    def hyphened(done):
        place = F.regexp_instr(done, F.lit(r"(?<=.\p{L})[0-9][0-9]"))
        hyphen = ~done.rlike(f"^(?:{FORMATS})$") & (F.instr(done, "-") == 0) & (place > 0)
        return F.when(hyphen, F.concat(F.substring(done, F.lit(1), place - 1), F.lit("-"), F.substring(done, place, _size(done)))).otherwise(done)

    def corrected(t):
        at = F.when(F.instr(t, "-") > 0, F.instr(t, "-") - 1).otherwise(format_break(t))
        fixed = F.struct(_once(at, lambda k: F.when(k > 0, k).otherwise(F.floor(_size(t) / 2))).alias("cut"), t.rlike(r"^[A-Z]\d{2,4}[A-Z]\d{1,2}$").alias("special"))
        done = _once(fixed, lambda x: letters(t, x["cut"], x["special"]))
        led = _once(done, lambda d: F.when(d.rlike("^[0-9]{3}.{2,}") & (density > 0) & (density < 0.01), F.concat(F.lit("A"), d)).otherwise(d))
        return F.when(_size(t) < 3, t).otherwise(_once(led, hyphened))

    return _once(_c(col), corrected)


def split_correct(col) -> Column:
    """Letters left of the hyphen (else of the third character), digits right of it."""
    t = _c(col)
    cut = F.when(F.instr(t, "-") > 0, F.instr(t, "-") - 1).otherwise(3)
    done = F.concat(F.translate(F.substring(t, F.lit(1), cut), *SWAP_LETTERS), F.translate(F.substring(t, cut + 1, F.greatest(_size(t), F.lit(1))), *SWAP_DIGITS))
    letters = _size(F.regexp_replace(F.substring(done, 1, 3), r"[^\p{L}]", ""))
    digits = _size(F.regexp_replace(F.substring(done, 4, 3), "[^0-9]", ""))
    hyphen = (_size(done) == 6) & (F.instr(done, "-") == 0) & (letters >= 2) & (digits >= 2)
    return F.when(hyphen, F.concat(F.substring(done, 1, 3), F.lit("-"), F.substring(done, 4, 3))).otherwise(done)


def region_normalise(col, blocked: list[str] = ()) -> Column:
    """Region ES: split into prefix and number, correct look-alikes in both, number of four
    or five characters; empty if longer than eight."""
    raw = F.upper(F.trim(_c(col)))
    t = F.regexp_replace(raw, r"[^\p{L}0-9-]", "")
    bare = F.regexp_replace(t, "-", "")
    letters, digits = F.regexp_replace(t, "[0-9]", ""), F.regexp_replace(t, "[^0-9]", "")
    two = F.regexp_extract
    one_each = t.rlike("^[0-9]+[^0-9]+$|^[^0-9]+[0-9]+$")
    # Where it splits: (prefix, number), null where it does not.
    by_hyphen = (F.instr(t, "-") > 0) & (_size(t) - _size(bare) == 1)
    prefix = F.when(by_hyphen, F.split_part(t, F.lit("-"), F.lit(1))).when(F.instr(t, "-") > 0, None).when(one_each, two(t, "^([0-9]+|[^0-9]+)", 1)).when((_size(t) >= 7) & (letters != "") & (digits != ""), F.substring(digits, 1, 4)).otherwise(F.substring(t, 1, 2))
    number = F.when(by_hyphen, F.split_part(t, F.lit("-"), F.lit(2))).when(one_each, two(t, "^(?:[0-9]+|[^0-9]+)(.*)$", 1)).when((_size(t) >= 7) & (letters != "") & (digits != ""), F.substring(letters, 1, 3)).otherwise(F.substring(t, F.lit(3), _size(t)))
    prefix = F.when(_size(prefix) <= 3, F.translate(prefix, *DIGIT_TO_LETTER)).otherwise(prefix)
    number = F.translate(number, *LETTER_TO_DIGIT)
    split = F.when((prefix != "") & (number != ""), F.concat_ws("-", prefix, number)).otherwise(F.concat(prefix, number))
    mid = F.when((_size(t) >= 6) & prefix.isNotNull(), split).otherwise(t)
    # Last form: only with exactly one hyphen.
    p, q = F.split_part(mid, F.lit("-"), F.lit(1)), F.split_part(mid, F.lit("-"), F.lit(2))
    p = F.when((_size(p) <= 3) & ~p.rlike("^[0-9]+$"), F.translate(p, *DIGIT_TO_LETTER)).otherwise(p)
    q = F.when(_size(q) > 5, F.substring(q, 1, 5)).when((_size(q) < 4) & q.rlike("^[0-9]+$"), F.lpad(q, 4, "0")).otherwise(q)
    last = F.when(_size(mid) - _size(F.regexp_replace(mid, "-", "")) == 1, F.concat(p, F.lit("-"), q)).otherwise(mid)
    bad = (_size(bare) > 8) | (_size(F.regexp_replace(last, "-", "")) > 8)
    for b in blocked:
        bad = bad | F.regexp_replace(raw, "[ -]", "").contains(b)
    return F.when(bad, "").otherwise(last)


def _has(t: Column, a: str, b: str) -> Column:
    return t.contains(a) & t.contains(b)


def detection_score(col, sharpness=None, blocked: list[str] = (), prefixes: dict[str, int] | None = None) -> Column:
    t = _c(col)
    n = _size(F.regexp_replace(t, "[- ]", ""))
    length = F.when(n > 8, -100).when(n.between(5, 7), 5).when(n.between(4, 8), 3).otherwise(1)
    form = F.when(t.rlike(r"^[A-Z]{2}-\d{4}$"), 8).when(t.rlike(r"^[A-Z]{3}-\d{4}$"), 5).when(t.rlike(r"^[A-Z]-\d{4,5}$"), 4).when(t.contains("-"), 2).otherwise(0)
    wrong = -2 * _size(F.regexp_replace(t, r"[\p{L}0-9-]", ""))
    mixed = _sum([F.when(_has(t, a, b), -1).otherwise(0) for a, b in ("LI", "O0", "S5", "B8")])
    tail = F.when(t.rlike(r"^[^-]*-\d+$"), 2).otherwise(0)
    parts = [length, form, wrong, mixed, tail]
    parts += [F.when(t.contains(b), -100).otherwise(0) for b in blocked]
    parts += [F.when(t.startswith(p), v).otherwise(0) for p, v in (prefixes or {}).items()]
    score = _sum(parts).cast("double")
    return score if sharpness is None else score + F.least(F.lit(5.0), F.coalesce(_c(sharpness) / 100, F.lit(0.0)))


def format_score(col) -> Column:
    """The format's part of a group's quality."""
    t = _c(col)
    base = F.when(t.rlike(r"^[A-Z]+-\d+$"), 1.0).when(t.rlike(r"^[A-Z]+\d+$"), 0.8).when(t.rlike(r"^\d+-[A-Z]+$"), 0.7).when(t.contains("-"), 0.5).otherwise(0.0)
    return F.when(_size(t) > 0, base + F.when(_size(t).between(6, 8), 0.1).otherwise(0.0) - F.when(t.rlike("[ÓÑÜÁÉÍÚÀÈÌÒÙ*#%&=]"), 0.3).otherwise(0.0)).otherwise(0.0)


def image_format_score(col) -> Column:
    """The format's part of an image's quality."""
    t = _c(col)
    base = F.when(t.rlike(r"^[A-Z]+-\d{4}$"), 1.0).when(t.rlike(r"^[A-Z]\d{4}[A-Z]?$"), 0.8).when(t.contains("-"), 0.7).otherwise(0.0)
    return F.when(_size(t) > 0, base + F.when(t.rlike(r"^[\p{L}0-9-]+$"), 0.1).otherwise(0.0)).otherwise(0.0)


def quality_score(col, plate_quality, vehicle_quality) -> Column:
    t, p, v = _c(col), F.coalesce(_c(plate_quality), F.lit(0.0)), F.coalesce(_c(vehicle_quality), F.lit(0.0))
    form = format_score(t)
    pattern = F.when(t.rlike(r"^[A-Z]{2,3}-\d{3,4}$"), 0.9).when(t.rlike(r"^[A-Z]-\d{3,5}$"), 0.8).when(t.rlike(r"^\d{3,4}-[A-Z]{2,3}$"), 0.7).otherwise(0.0)
    has = _c(vehicle_quality).isNotNull() & (_size(t) > 0)
    coherent = F.when(has & (p > 0.5) & (v > 0.5) & (form > 0.5), 0.8).when(has & ((p < 0.3) | (v < 0.3)), 0.2).otherwise(0.0)
    total = 0.4 * p + 0.2 * v + 0.2 * form + 0.1 * pattern + 0.1 * coherent
    return F.when((_size(t) > 0) & ~_size(t).between(4, 10), total * 0.7).otherwise(total)


def positional_matches(a, b) -> Column:
    return F.aggregate(F.zip_with(chars(a), chars(b), lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)


def hamming(a, b) -> Column:
    """Differing positions of texts of equal length, else null."""
    a, b = _c(a), _c(b)
    return F.when(_size(a) == _size(b), _size(a) - positional_matches(a, b))


def plate_similarity(a, b) -> Column:
    """Edit similarity with a share for look-alikes and 0.2 for an equal pattern, at most 1."""
    a, b = _c(a), _c(b)
    p, q = F.upper(F.regexp_replace(a, "-", "")), F.upper(F.regexp_replace(b, "-", ""))
    pair = lambda x, y: reduce(lambda u, v: u | v, [((x == s[0]) & (y == s[1])) | ((x == s[1]) & (y == s[0])) for s in SWAPPED])
    near = F.aggregate(F.zip_with(chars(p), chars(q), lambda x, y: F.when(pair(x, y), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    kind = lambda x: F.regexp_replace(F.regexp_replace(x, r"\p{L}", "L"), "[0-9]", "N")
    total = _similar(p, q) + 0.1 * near / F.greatest(F.lit(1), F.least(_size(p), _size(q))) + F.when(kind(p) == kind(q), 0.2).otherwise(0.0)
    return F.when((a == "") | (b == "") | a.isNull() | b.isNull(), 0.0).when(p == q, 1.0).when(F.abs(_size(p) - _size(q)) > 2, 0.0).otherwise(F.least(F.lit(1.0), total))


def text_similar(a, b) -> Column:
    a, b = _c(a), _c(b)
    p, q = F.regexp_replace(a, "-", ""), F.regexp_replace(b, "-", "")
    gap, most = F.abs(_size(p) - _size(q)), F.greatest(_size(p), _size(q))
    same = lambda x, y: reduce(lambda u, v: u | v, [x.isin(*s) & y.isin(*s) for s in EQUIVALENT], x == y)
    other = F.aggregate(F.zip_with(chars(p), chars(q), lambda x, y: F.when(x.isNull() | y.isNull() | same(x, y), 0).otherwise(1)), F.lit(0), lambda s, x: s + x)
    return F.when(a == b, True).when(p.contains(q) | q.contains(p), True).when(gap > 2, False).when(pattern_similarity(pattern_key(p), pattern_key(q)) > 0.8, True).otherwise(other + gap <= F.least(F.lit(2), F.floor(most / 3)))


def longest_digit_run(col) -> Column:
    """The first of the longest runs of digits."""
    return F.aggregate(F.regexp_extract_all(_c(col), F.lit(r"(\d+)")), F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))


def fold_confusable(col) -> Column:
    return F.translate(F.upper(_c(col)), *CONFUSABLE)


def normal_plate(col) -> Column:
    return F.upper(F.regexp_replace(_c(col), "[- ]", ""))


def common_suffix(a, b) -> Column:
    """Length of the longest common suffix."""
    x, y = F.reverse(chars(a)), F.reverse(chars(b))
    same = F.zip_with(x, y, lambda u, v: F.coalesce(u == v, F.lit(False)))
    stop = F.array_position(same, False)
    return F.when(stop > 0, stop - 1).otherwise(F.size(same)).cast("int")


def dup_text_similarity(a, b) -> Column:
    p, q = normal_plate(a), normal_plate(b)
    m, n = longest_digit_run(p), longest_digit_run(q)
    both = F.least(_size(m), _size(n)) >= 3
    suffix = common_suffix(m, n)
    digits = F.when(both & (m == n), 0.85).when(both & (suffix >= 3), 0.6 + suffix / F.greatest(_size(m), _size(n)) * 0.3).otherwise(0.0)
    return F.when(p == q, 1.0).when((digits < 0.8) & (fold_confusable(p) == fold_confusable(q)), 0.85).otherwise(digits)


def time_similarity(dt) -> Column:
    return F.when(F.abs(_c(dt)) < 5, 1 - F.abs(_c(dt)) / 5).otherwise(0.0)


def fused_weights(image, low) -> tuple[Column, Column, Column]:
    """Weights of text, image and time; ``low``: whether texts are less than half alike."""
    i = _c(image)
    high = i >= 0.7
    w = F.when(high & low, 0.3).when(high, 0.5).otherwise(0.6)
    v = F.when(i == 0, 0.0).when(high & low, 0.6).when(high, 0.4).otherwise(0.3)
    u = F.when(i == 0, 0.1 / 0.7).otherwise(0.1)
    return F.when(i == 0, 0.6 / 0.7).otherwise(w), v, u


def fused_similarity(text, image, time) -> Column:
    """Weighted text, image and time; absent (zero) parts give their weight away."""
    s, i, t = _c(text), _c(image), _c(time)
    w, v, u = fused_weights(i, s < 0.5)
    total = F.when(t == 0, w / (w + v) * s + v / (w + v) * i).otherwise(w * s + v * i + u * t)
    return F.when((i >= 0.75) & (t >= 0.8), F.greatest(total, F.lit(0.85))).otherwise(total)


def position_correct(col) -> Column:
    """Last 1 to L and 5 to S, then look-alike letters at positions 2 to 4 to digits."""
    t = F.regexp_replace(F.upper(_c(col)), "[^A-Z0-9]", "")
    n = _size(t)
    t2 = F.concat(F.substring(t, F.lit(1), n - 1), F.translate(F.substring(t, n, F.lit(1)), "15", "LS"))
    mid = F.concat(F.substring(t2, 1, 2), F.translate(F.substring(t2, 3, 3), "GSLIOAB", "6511048"), F.substring(t2, F.lit(6), F.greatest(n, F.lit(1))))
    return F.when(n < 4, t).otherwise(mid)


def six_g(col) -> Column:
    """6 to G at the first two places and the last, G to 6 between."""
    t = F.regexp_replace(F.upper(_c(col)), " ", "")
    n = _size(t)
    done = F.concat(F.translate(F.substring(t, 1, 2), "6", "G"), F.translate(F.substring(t, F.lit(3), n - 3), "G", "6"), F.translate(F.substring(t, n, F.lit(1)), "6", "G"))
    return F.when(n < 4, t).otherwise(done)


def region_of(col, default: str = "ES", regions: list[str] = tuple(REGIONS)) -> Column:
    name = F.upper(_c(col))
    return F.coalesce(*(F.when(name.contains(r), r) for r in regions), F.lit(default))


def adjusted_conf(conf, text, secondary=None) -> Column:
    """conf x (1.5 if the format is valid) x (1 + coherence, halved for secondary variants)."""
    part = pattern_coherence(text) if secondary is None else F.when(_c(secondary), 0.5).otherwise(1.0) * pattern_coherence(text)
    return _c(conf) * F.when(valid_format(text), 1.5).otherwise(1.0) * (1 + part)


def char_density(text, w, h) -> Column:
    return F.length(_c(text)) / F.nullif(_c(w) * _c(h), F.lit(0))


def valid_length(col, most: int = 8) -> Column:
    return F.length(F.regexp_replace(_c(col), r"[^\p{L}0-9]", "")) <= most


#: Functions of texts alone that SQL can write down, by their number of arguments (it cannot
#: write lambdas, and its parser does not take the length of ``region_normalise``).
SQL_FUNCTIONS = {
    1: (clean_plate, complies_7, format_7, valid_format, valid_plate, pattern_key, pattern_coherence, format_break, split_correct, detection_score, format_score, image_format_score, fold_confusable, normal_plate, position_correct, six_g, region_of, valid_length),
    2: (pattern_similarity,),
}


def register(spark, prefix: str = "") -> list[str]:
    """Publish the text functions as temporary SQL functions of the session; returns their
    names. Each is defined by its expression's own SQL, so Catalyst sees through it."""
    names = []
    for n, functions in SQL_FUNCTIONS.items():
        args = ["a", "b"][:n]
        rows = spark.createDataFrame([], ", ".join(f"{x} string" for x in args))
        for f in functions:
            body = rows.select(f(*map(F.col, args)).alias("r"))._jdf.queryExecution().analyzed().expressions().head().sql().removesuffix(" AS r")
            name = f"{prefix}{f.__name__}"
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(f'{x} STRING' for x in args)}) RETURN {body}")
            names.append(name)
    return names
