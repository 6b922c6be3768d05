"""Column functions: text keys, calendar, odds, bands, ratios and templates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Generational suffixes that are not part of a name.
NAME_SUFFIX = r"\b(jr|sr|i{1,3}|iv|v|vi{1,3}|ix|x|xi{1,3})\b"

# Words that mark an illness or a reason other than injury.
ILLNESS_WORDS = "illness|covid|appendix|appendicitis|headache"
NOT_INJURY_WORDS = "not injury related|personal|team decision|travel|suspension|coach|jury duty|rest"
CONFERENCE_WORDS = "press conference|coach"

# Ordered labels of the expected-value bands, best first.
EV_BANDS = [
    "Very High", "High", "A little high", "Slightly above break-even", "Slightly below break-even",
    "A little low", "Low", "Very Low", "Extremely Low",
]
EV_FLOORS = [100, 50, 20, 0, -5, -20, -30, -50]

# Ordered labels of the odds bands, shortest first.
ODDS_BANDS = [
    "Negative Odds", "Positive Odds Up To +250", "Odds +251 to +450", "Odds +451 to +650",
    "Odds +651 to +1000", "Odds +1000 to +2000", "Odds above +2000",
]
ODDS_CEILINGS = [0, 250, 450, 650, 1000, 2000]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- text -----------------------------------------------------------------------------------


def name_key(c: Column | str) -> Column:
    """Comparable form of a personal name."""
    x = F.lower(_col(c))
    x = F.regexp_replace(x, r"\([^)]*\)", "")
    x = F.regexp_replace(x, r"[^\p{L}\p{M}\p{N} ]+", "")  # letters of any script stay
    x = F.regexp_replace(x, NAME_SUFFIX, "")
    return F.trim(F.regexp_replace(x, r" +", " "))


def mentions(c: Column | str, words: str) -> Column:
    """Does the text contain one of the words, given as ``a|b|c``?  Plain words need no regex."""
    text = F.lower(_col(c))
    parts = words.split("|")
    if not all(p.replace(" ", "").isalnum() for p in parts):
        return text.rlike(words)
    found = text.contains(parts[0])
    for p in parts[1:]:
        found = found | text.contains(p)
    return found


def status_flags(c: Column | str, division_table: bool = False) -> dict[str, Column]:
    """Clinch and elimination markers in front of an upper-case team code.

    In the overall list a marker implies the weaker ones; in a division's table each stands for itself.
    """
    marker = F.regexp_replace(_col(c), "[^a-z]", "")
    if division_table:
        alone = {"clinched_playoff": "x", "clinched_division": "y", "clinched_seed1": "z", "eliminated": "e", "eliminated_division": "k"}
        return {name: marker.contains(m) for name, m in alone.items()} | {"team_code": F.regexp_extract(_col(c), "[A-Z]+", 0)}
    return {
        "clinched_playoff": marker.rlike("[xyz]"),
        "clinched_division": marker.rlike("[yz]"),
        "clinched_seed1": marker.contains("z"),
        "eliminated": marker.contains("e"),
        "eliminated_division": marker.rlike("[ke]"),
        "team_code": F.regexp_extract(_col(c), "[A-Z]+", 0),
    }


def record_share(c: Column | str) -> Column:
    """``wins-losses`` text to the share of games won; NULL when no game was played."""
    parts = F.split(_col(c), "-")
    won, lost = parts[0].cast("double"), parts[1].cast("double")
    return F.try_divide(won, won + lost)


def ladder_number(c: Column | str) -> Column:
    text = F.replace(_col(c), F.lit("minus"), F.lit("-"))
    return F.nullif(F.regexp_extract(text, r"-?[0-9]+([.][0-9]+)?", 0), F.lit("")).cast("double")


def ladder_root(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"_(minus)?[0-9]+([.][0-9]+)?$", "")


def ladder_code(root: Column | str, number: Column | str) -> Column:
    """Inverse of the two functions above: ``-7.5`` becomes ``minus7.5``."""
    n = _col(number)
    whole = F.abs(n) == F.floor(F.abs(n))
    digits = F.when(whole, F.abs(n).cast("bigint").cast("string")).otherwise(F.abs(n).cast("string"))
    return F.concat(_col(root), F.lit("_"), F.when(n < 0, "minus").otherwise(""), digits)


def bet_type(response_var: Column | str) -> Column:
    """Target code without its rung; the two targets without rungs stay whole."""
    return F.regexp_replace(_col(response_var), r"^(?!anytime_td_scorer$|team_win$)(.*)_[^_]*$", "$1")


def bet_category(response_var: Column | str) -> Column:
    r = _col(response_var)
    return (
        F.when(r.contains("rushing_receiving"), "Rush + Receiving")
        .when(r.contains("receiving"), "Receiving")
        .when(r.contains("rushing"), "Rushing")
        .when(r.contains("passing"), "Passing")
        .when(r.contains("receptions"), "Receptions")
        .when(r.contains("anytime_td"), "ATD")
        .when(r.contains("team"), "Team")
        .otherwise("Other")
    )


def pair_key(a: Column | str, b: Column | str, sep: str = "-") -> Column:
    x, y = _col(a).cast("string"), _col(b).cast("string")
    return F.concat_ws(sep, F.least(x, y), F.greatest(x, y))


def is_press_conference(title: Column | str) -> Column:
    """A title with ``press``, or with both ``address`` and ``media``; upper and lower case are alike."""
    return mentions(title, "press") | (mentions(title, "address") & mentions(title, "media"))


# --- calendar -------------------------------------------------------------------------------


def season_of(ts: Column | str, first_month: int = 3) -> Column:
    """Months before ``first_month`` belong to the season that began the year before."""
    t = _col(ts)
    return F.when(F.month(t) < first_month, F.year(t) - 1).otherwise(F.year(t)).cast("bigint")


def posted_season(ts: Column | str, week: Column | str) -> Column:
    """Season of a post: one of January or February that lies in no week (0 or NULL) counts for the next season."""
    late = (F.coalesce(_col(week), F.lit(0)) == 0) & (F.month(_col(ts)) < 3)
    return season_of(ts) + late.cast("bigint")


def age_years(event: Column | str, birth: Column | str) -> Column:
    return F.datediff(_col(event), _col(birth)) / F.lit(365.0)


def on_birthday(event: Column | str, birth: Column | str) -> Column:
    return F.date_format(_col(event), "MM-dd") == F.date_format(_col(birth), "MM-dd")


def local_day(utc: Column | str, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(_col(utc).cast("timestamp"), zone))


def minutes_before(run: Column | str, start: Column | str) -> Column:
    delta = F.unix_micros(_col(start).cast("timestamp")) - F.unix_micros(_col(run).cast("timestamp"))
    return delta / F.lit(60_000_000.0)


# fixed values: hours at which the parts of a day end, for games and for the weekly sheet
GAME_HOURS, SHEET_HOURS = (12, 14, 19), (11, 15, 19)


def day_part(hour: Column | str, ends: tuple[int, int, int] = GAME_HOURS) -> Column:
    h = _col(hour)
    return F.when(h < ends[0], "Morning").when(h < ends[1], "Early Window").when(h < ends[2], "Late Window").otherwise("Night")


# --- odds and bands -------------------------------------------------------------------------


def american_to_number(text: Column | str) -> Column:
    """``+150`` or ``−150`` (any minus sign) to a double."""
    t = F.regexp_replace(_col(text), "[−–]", "-")
    return F.replace(t, F.lit("+"), F.lit("")).cast("double")


def profit_per_100(odds: Column | str) -> Column:
    o = _col(odds)
    return F.when(o > 0, o).otherwise(F.try_divide(F.lit(10000.0), -o))


def implied_probability(odds: Column | str) -> Column:
    o = _col(odds)
    return F.when(o > 0, 100.0 / (o + 100.0)).when(o < 0, -o / (-o + 100.0))


def payout(stake: Column | str, odds: Column | str) -> Column:
    return _col(stake) * (1.0 + profit_per_100(odds) / 100.0)


def expected_value(p: Column | str, odds: Column | str) -> Column:
    q = _col(p)
    return q * profit_per_100(odds) - 100.0 * (1.0 - q)


def bet_risk(p: Column | str, odds: Column | str) -> Column:
    q, swing = _col(p), profit_per_100(odds) / 100.0 + 1.0
    return q * (1.0 - q) * swing * swing


def probability_bin(p: Column | str) -> tuple[Column, Column]:
    """Floor and ceiling in basis points: 2 % wide below 10 %, 5 % to 30 %, then 10 %.

    Whole basis points keep the bin edges exact.
    """
    bp = F.round(_col(p) * 10000).cast("bigint")

    def low(width: int, origin: int) -> Column:
        return bp - F.pmod(bp - origin, F.lit(width))

    floor = F.when(bp < 1000, low(200, 0)).when(bp < 3000, low(500, 1000)).otherwise(low(1000, 3000))
    width = F.when(bp < 1000, 200).when(bp < 3000, 500).otherwise(1000)
    return floor, floor + width


def with_probability_bin(df: DataFrame, p: str) -> DataFrame:
    floor, ceiling = probability_bin(p)
    out = df.withColumns({"_floor": floor, "_ceiling": ceiling})
    label = F.concat((F.col("_floor") / 100).cast("bigint"), F.lit("% to "), (F.col("_ceiling") / 100).cast("bigint"), F.lit("%"))
    return out.select(
        *df.columns,
        (F.col("_floor") / 10000.0).alias("probability_floor"),
        (F.col("_ceiling") / 10000.0).alias("probability_ceiling"),
        label.alias("probability_range"),
    )


def cut(c: Column | str, edges: Sequence[float], labels: Sequence[str], right: bool = True) -> tuple[Column, Column]:
    """Label and order of the interval a value falls in, open at both ends.

    ``right`` puts a value equal to an edge in the interval below that edge.
    """
    if len(labels) != len(edges) + 1:
        raise ValueError("cut needs one label more than it has edges")
    x = _col(c)
    label: Column | None = None
    order: Column | None = None
    for i, edge in enumerate(edges):
        inside = x <= edge if right else x < edge
        label = F.when(inside, labels[i]) if label is None else label.when(inside, labels[i])
        order = F.when(inside, i) if order is None else order.when(inside, i)
    last = x.isNotNull()
    return label.when(last, labels[-1]), order.when(last, len(edges)).cast("bigint")


def odds_band(odds: Column | str, right: bool = False) -> tuple[Column, Column]:
    return cut(odds, ODDS_CEILINGS, ODDS_BANDS, right=right)


def ev_band(ev: Column | str) -> tuple[Column, Column]:
    label, order = cut(-_col(ev), [-f for f in EV_FLOORS], EV_BANDS, right=False)
    return label, order


# --- ratios and rows ------------------------------------------------------------------------


def ratio_columns(spec: Mapping[str, tuple[str, str]], columns: Sequence[str], last: str | None = None) -> list[Column]:
    """One safe ratio per metric whose inputs exist, plus the trailing form when asked for."""
    have = set(columns)
    out = [F.try_divide(n, d).alias(k) for k, (n, d) in spec.items() if {n, d} <= have]
    if last:
        out += [
            F.try_divide(last + n, last + d).alias(last + k)
            for k, (n, d) in spec.items()
            if {last + n, last + d} <= have
        ]
    return out


def row_spread(cols: Sequence[str]) -> Column:
    return F.greatest(*cols) - F.least(*cols)


def non_null_count(cols: Sequence[str]) -> Column:
    total = F.lit(0)
    for c in cols:
        total = total + F.col(c).isNotNull().cast("int")
    return total.cast("bigint")


def normal_upper_tail(z: Column | str) -> Column:
    """P(Z > z) by a published rational approximation (absolute error below 7.5e-8)."""
    x = _col(z)
    a = F.abs(x)
    t = 1.0 / (1.0 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2.0) / 2.5066282746310002 * poly
    return F.when(x >= 0, tail).otherwise(1.0 - tail)
