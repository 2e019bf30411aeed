"""Map arbitrarily named columns onto the canonical ad schema.

Decisions on column *names* are plain Python on ``df.columns``. Everything
that looks at data is one aggregate job (``infer_profile``): per column the
mean, the non-null count, the share of text values that look like a date, an
approximate distinct count, and for text columns how many non-null values fail
each date format. The reference looks at "the first value" or "the first 100
values"; a distributed table has no first row, so whole-column shares are
used instead (documented difference).

Two profiles, kept as data: ``lean`` (the recommended script) and ``wide``
(the full package). ``exact_first=True`` maps a column whose name equals a
field before any pattern is tried (optional, not in the reference).
"""

from __future__ import annotations

import datetime as _dt
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StringType, TimestampNTZType, TimestampType

from adlens.operators.rowid import row_index
from adlens.sources.facts import AD_COLUMNS

# ---- fixed values: name patterns per field, in matching order (lean profile) ----
LEAN_PATTERNS = {
    "date": [r"date", r"day", r"time", r"timestamp", r"created", r"period", r"dt", r"report"],
    "campaign_id": [r"campaign_id", r"camp_id", r"adgroup_id", r"ad_id", r"^id$", r"cid"],
    "campaign_name": [r"campaign_name", r"name", r"title", r"ad_name", r"adgroup", r"ad_group", r"campaign$"],
    "impressions": [r"impression", r"impr", r"views", r"imp", r"shows", r"reach", r"display"],
    "clicks": [r"click", r"clk", r"visits", r"sessions", r"hits", r"tap"],
    "conversions": [r"conversion", r"conv", r"purchase", r"order", r"lead", r"action", r"signup", r"install"],
    "spend": [r"spend", r"cost", r"expense", r"budget", r"amount_spent", r"media_cost", r"ad_cost"],
    "revenue": [r"revenue", r"income", r"sales", r"value", r"earning", r"gmv", r"amount", r"total"],
    "region": [r"region", r"country", r"location", r"geo", r"territory", r"market", r"area", r"state", r"city"],
    "platform": [r"platform", r"source", r"channel", r"network", r"medium", r"publisher", r"traffic"],
}

# ---- fixed values: name patterns per field, in matching order (wide profile) ----
WIDE_PATTERNS = {
    "date": [r"date", r"day", r"time", r"timestamp", r"created", r"period", r"report_date", r"data_date",
             r"event_date", r"dt"],
    "campaign_id": [r"campaign_id", r"campaign", r"camp_id", r"adgroup_id", r"ad_id", r"id", r"campaign_key", r"cid"],
    "campaign_name": [r"campaign_name", r"name", r"campaign_title", r"ad_name", r"title", r"adgroup_name",
                      r"ad_group", r"campaign$"],
    "impressions": [r"impression", r"impr", r"views", r"imp", r"shows", r"reach", r"display", r"served"],
    "clicks": [r"click", r"clk", r"visits", r"sessions", r"hits"],
    "conversions": [r"conversion", r"conv", r"purchase", r"order", r"transaction", r"signup", r"lead", r"action",
                    r"goal", r"sale"],
    "spend": [r"spend", r"cost", r"expense", r"budget", r"investment", r"ad_spend", r"media_cost", r"amount_spent"],
    "revenue": [r"revenue", r"income", r"sales", r"value", r"earning", r"conversion_value", r"total_value", r"gmv",
                r"amount"],
    "region": [r"region", r"country", r"location", r"geo", r"territory", r"market", r"area", r"state", r"city"],
    "platform": [r"platform", r"source", r"channel", r"network", r"medium", r"publisher", r"ad_platform",
                 r"traffic_source"],
}

# ---- fixed values: text that counts as a date (matched at the start), per profile ----
LEAN_DATE_TEXT = [r"\d{4}-\d{2}-\d{2}", r"\d{2}/\d{2}/\d{4}"]
WIDE_DATE_TEXT = [r"\d{4}-\d{2}-\d{2}", r"\d{2}/\d{2}/\d{4}", r"\d{2}-\d{2}-\d{4}"]

# ---- fixed values: defaults ----
NUMERIC_DEFAULTS = [("impressions", 0), ("clicks", 0), ("conversions", 0), ("spend", 0.0), ("revenue", 0.0)]
DEFAULT_NAME = {"lean": "Campaign_1", "wide": "Campaign"}
LARGE_MEAN = {"lean": 100.0, "wide": 1000.0}

# Formats tried when a text date column is parsed; the first format under
# which every non-null value parses wins, otherwise the column stays text.
DATE_FORMATS = ["yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "dd/MM/yyyy", "yyyy.MM.dd", "dd.MM.yyyy"]

# The same formats as shapes: where each field stands in ten characters, and what else may parse (a signed or longer year).
_ISO_PARTS = {True: (1, 6, 9), False: (7, 4, 1)}  # year first or last: starts of year, month, day
_DIGITS = {True: "[0-9]{4}%s[0-9]{2}%s[0-9]{2}", False: "[0-9]{2}%s[0-9]{2}%s[0-9]{4}"}
_LONGER = {True: "[+-]?[0-9]{4,}%s[0-9]{2}%s[0-9]{2}", False: "[0-9]{2}%s[0-9]{2}%s[+-]?[0-9]{4,}"}

CANONICAL_TYPES = {
    "campaign_id": "string", "campaign_name": "string", "impressions": "bigint", "clicks": "bigint",
    "conversions": "bigint", "spend": "double", "revenue": "double", "region": "string", "platform": "string",
}


def patterns(profile: str) -> dict[str, list[str]]:
    if profile not in ("lean", "wide"):
        raise ValueError(f"unknown profile {profile!r}; use 'lean' or 'wide'")
    return LEAN_PATTERNS if profile == "lean" else WIDE_PATTERNS


def match_column(name: str, profile: str = "lean", exact_first: bool = False) -> str | None:
    """First field (in pattern-dict order) with any unanchored pattern hit."""
    low = name.lower().strip()
    pats = patterns(profile)
    if exact_first and low in pats:
        return low
    for fld, ps in pats.items():
        if any(re.search(p, low) for p in ps):
            return fld
    return None


def _is_numeric(dt) -> bool:
    return isinstance(dt, NumericType)


def _is_dateish(dt) -> bool:
    return isinstance(dt, (DateType, TimestampType, TimestampNTZType))


def date_of(x, fmt: str):
    """``F.try_to_date(x, fmt)`` for ``DATE_FORMATS``, without a parser that fails by an exception for each other text.

    Ten characters of the format's shape are put in ISO order and cast; only text with a signed or longer year goes to the parser.
    """
    x = F.col(x) if isinstance(x, str) else x
    first = fmt.startswith("y")
    sep, (y, m, d) = fmt.strip("yMd")[0], _ISO_PARTS[first]
    shape = lambda by: f"^{by[first] % ((re.escape(sep),) * 2)}$"
    here = (F.substring(x, 5 if first else 3, 1) == sep) & x.rlike(shape(_DIGITS))
    iso = F.concat(F.substring(x, y, 4), F.lit("-"), F.substring(x, m, 2), F.lit("-"), F.substring(x, d, 2)) if (first, sep) != (True, "-") else x
    return F.when(F.length(x) == 10, F.when(here, iso.try_cast("date"))).when(x.rlike(shape(_LONGER)), F.try_to_date(x, fmt))


def infer_profile(df: DataFrame, cols: list[str] | None = None, profile: str = "lean",
                  exact_distinct: bool = False) -> dict[str, dict]:
    """One aggregate job: the data facts N3/N7 need, per column.

    ``date_text_by`` has both profiles' counts, ``date_text`` that of ``profile``. Distinct values are sketched; a
    column whose share lies near one half, where a verdict turns, is counted exactly (one more job for all of them).
    """
    cols = list(df.columns if cols is None else cols)
    types = {f.name: f.dataType for f in df.schema.fields}
    date_re = {name: "^(" + "|".join(text) + ")" for name, text in (("lean", LEAN_DATE_TEXT), ("wide", WIDE_DATE_TEXT))}
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`")
        aggs.append(F.count(x).alias(f"nn{i}"))
        if _is_numeric(types[c]):
            aggs.append(F.avg(x.cast("double")).alias(f"mean{i}"))
        elif isinstance(types[c], StringType):
            aggs += [F.count_if(x.rlike(text)).alias(f"dt{i}_{name}") for name, text in date_re.items()]
            aggs.append((F.count_distinct(x) if exact_distinct else F.approx_count_distinct(x)).alias(f"nd{i}"))
            for j, fmt in enumerate(DATE_FORMATS):
                aggs.append(F.count_if(x.isNotNull() & date_of(x, fmt).isNull()).alias(f"bad{i}_{j}"))
    row = df.agg(*aggs).first().asDict() if aggs else {}
    close = [] if exact_distinct else [i for i, c in enumerate(cols) if isinstance(types[c], StringType) and row[f"nn{i}"] and 0.4 <= row[f"nd{i}"] / row[f"nn{i}"] <= 0.6]
    if close:
        row |= df.agg(*[F.count_distinct(F.col(f"`{cols[i]}`")).alias(f"nd{i}") for i in close]).first().asDict()
    out = {}
    for i, c in enumerate(cols):
        out[c] = {
            "dtype": types[c].simpleString(), "non_null": row.get(f"nn{i}", 0), "mean": row.get(f"mean{i}"),
            "date_text": row.get(f"dt{i}_{profile}"), "date_text_by": {name: row.get(f"dt{i}_{name}") for name in date_re}, "distinct": row.get(f"nd{i}"),
            "bad_formats": [row.get(f"bad{i}_{j}") for j in range(len(DATE_FORMATS))]
            if isinstance(types[c], StringType) else None,
        }
    return out


def classify(dtype, facts: dict, profile: str = "lean") -> str:
    """The inferred kind of one column from its type and data facts."""
    nn = facts["non_null"]
    if profile == "wide" and nn == 0:
        return "unknown"
    if _is_dateish(dtype):
        return "date"
    if isinstance(dtype, StringType):
        if nn and facts["date_text"] * 2 >= nn:
            return "date"
        if profile == "lean":
            return "text"
        return "categorical_high_cardinality" if nn and facts["distinct"] / nn > 0.5 else "categorical"
    if _is_numeric(dtype):
        m = facts["mean"]
        if m is not None and m > LARGE_MEAN[profile]:
            return "metric_large"
        if profile == "wide" and dtype.typeName() in ("double", "float", "decimal"):
            return "metric_decimal"
        return "metric_small"
    return "unknown"


def infer_column_types(df: DataFrame, cols: list[str] | None = None, exact_distinct: bool = False) -> DataFrame:
    """N3 as a table: one row per column with both profiles' verdicts, from one set of facts."""
    cols = list(df.columns if cols is None else cols)
    types = {f.name: f.dataType for f in df.schema.fields}
    facts = infer_profile(df, cols, "lean", exact_distinct)
    kind = lambda c, profile: classify(types[c], facts[c] | {"date_text": facts[c]["date_text_by"][profile]}, profile)
    rows = [(i, c, types[c].simpleString(), int(facts[c]["non_null"]), kind(c, "lean"), kind(c, "wide")) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(
        rows, "ordinal int, column_name string, dtype string, non_null long, lean_type string, wide_type string")


@dataclass
class MappingReport:
    """What the normalizer did."""
    profile: str
    original_columns: list[str]
    mapping: dict[str, str] = field(default_factory=dict)
    how: dict[str, str] = field(default_factory=dict)
    synthetic: list[str] = field(default_factory=list)
    inferred_types: dict[str, str] = field(default_factory=dict)
    available_metrics: list[str] = field(default_factory=list)
    date_format: str | None = None

    def to_rows(self) -> list[tuple]:
        rows = [(o, f, self.how.get(o, "pattern")) for o, f in self.mapping.items()]
        rows += [(None, s, "synthetic") for s in self.synthetic]
        return rows


def plan_mapping(df: DataFrame, profile: str = "lean", custom_mapping: dict[str, str] | None = None,
                 exact_first: bool = False, facts: dict | None = None) -> tuple[dict, list, MappingReport, dict]:
    """N1-N5 on the driver: returns (mapping, unmapped, report, per-column facts)."""
    cols = list(df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    rep = MappingReport(profile, cols)
    mapping: dict[str, str] = {}
    taken: set[str] = set()
    unmapped: list[str] = []
    if exact_first:                                  # optional: exact names claim their field first
        for c in cols:
            low = c.lower().strip()
            if low in patterns(profile) and low not in taken:
                mapping[c], rep.how[c] = low, "exact"
                taken.add(low)
    for c in cols:                                   # N1 + N2: first come, no second choice
        if c in mapping:
            continue
        fld = match_column(c, profile)
        if fld and fld not in taken:
            mapping[c], rep.how[c] = fld, "pattern"
            taken.add(fld)
        else:
            unmapped.append(c)
    if facts is None:
        # data facts only where a decision needs them: unmapped columns (N3/N4) and a
        # text column mapped to date (N7); nothing to look at -> no job at all
        need = list(unmapped)
        need += [c for c, f in mapping.items() if f == "date" and isinstance(types[c], StringType)]
        if "date" in cols and "date" not in mapping and isinstance(types["date"], StringType):
            need.append("date")
        facts = infer_profile(df, sorted(set(need), key=cols.index), profile) if need else {}
    for c in list(unmapped):                         # N3 + N4: fill gaps by type
        kind = classify(types[c], facts[c], profile)
        rep.inferred_types[c] = kind
        target = {"date": "date", "metric_large": "impressions"}.get(kind)
        if profile == "wide" and kind == "metric_decimal":
            target = "revenue"
        if target and target not in taken:
            mapping[c], rep.how[c] = target, "type"
            taken.add(target)
            unmapped.remove(c)
    for orig, fld in (custom_mapping or {}).items():  # N5: overrides win
        if orig in cols:
            mapping[orig], rep.how[orig] = fld, "custom"
    dup = [f for f in set(mapping.values()) if list(mapping.values()).count(f) > 1]
    if dup:
        raise ValueError(f"two columns map to the same field(s) {sorted(dup)}: {mapping}")
    rep.mapping = dict(mapping)
    return mapping, unmapped, rep, facts


def normalize(df: DataFrame, profile: str = "lean", custom_mapping: dict[str, str] | None = None,
              run_date: _dt.date | str | None = None, order_by: list[str] | None = None,
              canonical: bool = True, exact_first: bool = False, keep: list[str] | None = None) -> tuple[DataFrame, MappingReport]:
    """Canonical ad columns (extra columns kept); returns (df, report).

    ``run_date`` is the literal used when there is no date column (default:
    today, as in the reference; pass it for reproducible output). ``order_by``
    gives synthetic 1..n campaign ids a defined order. ``canonical`` casts the
    ten fields to the canonical types (a date that does not parse stays text).
    ``keep``: columns that are carried along and never mapped (a report's key).
    """
    mapping, unmapped, rep, facts = plan_mapping(df.drop(*keep) if keep else df, profile, custom_mapping, exact_first)
    renamed = [mapping.get(c, c) for c in df.columns]
    clash = sorted({n for n in renamed if renamed.count(n) > 1})
    if clash:
        raise ValueError(f"normalized names clash: {clash} (mapping {mapping}); use custom_mapping or exact_first")
    out = df.withColumnsRenamed(mapping) if mapping else df
    have = set(out.columns)
    types = {f.name: f.dataType for f in out.schema.fields}

    # Date default or parse (all-or-nothing per column, format chosen from the data)
    if "date" not in have:
        d = run_date or _dt.date.today()
        out = out.withColumn("date", F.lit(str(d)))
        rep.synthetic.append("date")
        if canonical:
            out = out.withColumn("date", F.to_date("date"))
    elif isinstance(types["date"], StringType):
        src = next(o for o, f in mapping.items() if f == "date") if "date" in mapping.values() else "date"
        bad = facts[src]["bad_formats"] if src in facts else None
        if bad is None:
            bad = infer_profile(df, [src], profile)[src]["bad_formats"]
        ok = [j for j, b in enumerate(bad) if b == 0]
        if ok:
            rep.date_format = DATE_FORMATS[ok[0]]
            out = out.withColumn("date", date_of("date", rep.date_format))
    elif canonical and isinstance(types["date"], (TimestampType, TimestampNTZType)):
        out = out.withColumn("date", F.col("date").cast("date"))

    # Campaign name and id
    if "campaign_name" not in have:
        if "campaign_id" in have:
            out = out.withColumn("campaign_name", F.col("campaign_id").cast("string"))
        else:
            out = out.withColumn("campaign_name", F.lit(DEFAULT_NAME[profile]))
        rep.synthetic.append("campaign_name")
    if "campaign_id" not in have:
        if profile == "wide" and "campaign_name" in have:
            out = out.withColumn("campaign_id", F.col("campaign_name"))
        else:
            start = 1 if profile == "lean" else 0
            out = row_index(out, "campaign_id", start=start, order_by=order_by)
            out = out.withColumn("campaign_id", F.col("campaign_id").cast("string"))
        rep.synthetic.append("campaign_id")

    # Metrics: keep, adopt the first unused numeric column, or default
    for fld, default in NUMERIC_DEFAULTS:
        if fld in out.columns:
            rep.available_metrics.append(fld)
            continue
        cur = {f.name: f.dataType for f in out.schema.fields}
        adopt = next((c for c in unmapped if c in cur and _is_numeric(cur[c])), None)
        if adopt is not None:
            out = out.withColumnRenamed(adopt, fld)
            unmapped.remove(adopt)
            rep.mapping[adopt], rep.how[adopt] = fld, "adopted"
            rep.available_metrics.append(fld)
        else:
            out = out.withColumn(fld, F.lit(default))
            rep.synthetic.append(fld)

    # N11
    for fld in ("region", "platform"):
        if fld not in out.columns:
            out = out.withColumn(fld, F.lit("Unknown"))
            rep.synthetic.append(fld)

    if canonical:
        out = out.withColumns({c: F.col(c).cast(t) for c, t in CANONICAL_TYPES.items()})
    lead = [c for c in AD_COLUMNS]
    return out.select(*lead, *[c for c in out.columns if c not in lead]), rep


def parse_dates(df: DataFrame, cols: list[str], fmt: str = "yyyy-MM-dd") -> DataFrame:
    """Strict text -> date for the listed columns that exist.

    Strict as in the reference: a value that does not parse raises (ANSI
    ``to_date``). Columns that are already dates are left alone.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    todo = {c: F.to_date(F.col(c), fmt) for c in cols if c in types and isinstance(types[c], StringType)}
    return df.withColumns(todo) if todo else df


def discover_catalog(df: DataFrame, feed_col: str, json_col: str) -> DataFrame:
    """The columns that JSON objects of each feed hold: (feed, ordinal, column_name, dtype, rows).

    Keys and types come from the data by one aggregate; types of a key are merged (whole numbers and fractions give
    DOUBLE, types that have nothing in common VARIANT). Ordinals follow the names, as JSON objects have no order.
    Text that is null, no JSON, or no object adds nothing.
    """
    from pyspark.sql import Window
    parsed = df.select(F.col(feed_col).alias("feed"), F.try_parse_json(json_col).alias("v"))
    parts = parsed.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer())).where("key IS NOT NULL")
    found = parts.groupBy("feed", "key").agg(F.schema_of_variant_agg("value").alias("t"), F.count(F.lit(1)).alias("rows"))
    whole = F.col("t").rlike(r"^DECIMAL\(\d+,0\)$")
    dtype = F.when(whole, "BIGINT").when(F.col("t").startswith("DECIMAL"), "DOUBLE").otherwise(F.col("t"))
    order = Window.partitionBy("feed").orderBy("key")  # the keys of one feed
    return found.select("feed", (F.row_number().over(order) - 1).alias("ordinal"), F.col("key").alias("column_name"), dtype.alias("dtype"), "rows")


def map_columns_catalog(catalog: DataFrame, profile: str = "lean") -> DataFrame:
    """N1 + N2 over a schema catalog ``(feed, ordinal, column_name)`` for many feeds at once.

    N1 is one CASE expression over the fixed patterns (first field with any hit,
    no join); N2 keeps, per (feed, field), the column with the lowest ordinal --
    a window over the columns of one feed, never a whole table.
    """
    from pyspark.sql import Window
    low = F.lower(F.trim(F.col("column_name")))
    best = None
    for fld, ps in patterns(profile).items():
        hit = None
        for p in ps:
            h = low.rlike(p)
            hit = h if hit is None else hit | h
        best = F.when(hit, F.lit(fld)) if best is None else best.when(hit, F.lit(fld))
    cand = catalog.withColumn("__best", best)
    w = Window.partitionBy("feed", "__best").orderBy("ordinal")
    won = F.when(F.col("__best").isNotNull() & (F.row_number().over(w) == 1), F.col("__best"))
    return cand.select("feed", "ordinal", "column_name", won.alias("field"))
