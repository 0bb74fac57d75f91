"""Facts, spans and identities of documents, relative dates and calendars, checks and collection; signals of sessions and what is held by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark.operators import series as S
from tidemark.plans.base import BARS_SQL, PANEL_SQL, bars, panel, r6, sessions
from tidemark.plans.problems import session_of_days
from tidemark.scale import broadcast_if_bounded
from tidemark.sources.tables import load
from tidemark.streaming import bars as stream

QUERIES, ORACLES = {}, {}
LAG = "OVER (PARTITION BY security_id ORDER BY session_no)"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def r(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


def day(c):
    return F.date_format(c, "yyyy-MM-dd")


#: labels of a headline in the order in which they are tried
HEADLINES = [
    ("LEGAL_NOTICE", r"\b(court|tribunal|sued|regulator|settles?|settlement)\b"),
    ("OWNERSHIP_UPDATE", r"\b(stake|shareholders?|shares outstanding|insider)\b"),
    ("EARNINGS_PREVIEW", r"\b(ahead of its results|is expected to report)\b"),
    ("DEAL_TERMINATION", r"\b(abandons?|calls? off)\b.*\b(agreement|takeover)\b"),
    ("EARNINGS", r"\b(fourth|first|second|third)-quarter\b|\bcents per share\b"),
    ("M_AND_A", r"\b(agreement to buy|takeover|takes over)\b"),
    ("COMMERCIAL_CONTRACT", r"\b(order|contract) (worth|for)\b|\bsupply agreement\b"),
    ("GUIDANCE", r"\b(outlook|full-year|capital spending)\b"),
]
_TITLE = "lower(regexp_replace(split_part(ltrim(coalesce(text, ''), chr(10) || chr(13) || ' '), chr(10), 1), '<[^<>]*>', '', 'g'))"


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches({_TITLE}, '{p}') THEN '{k}'" for k, p in HEADLINES) + " ELSE 'UNKNOWN' END AS label FROM documents")
def e01_headline(spark, at):
    """The first of an ordered cascade of patterns that the headline of a text holds."""
    first = F.substring_index(F.ltrim(F.coalesce("text", F.lit("")), F.lit("\n\r ")), "\n", 1)
    title = F.lower(F.regexp_replace(first, r"<[^<>]*>", ""))
    return load(spark, at, "documents", "doc_id", "text").select("doc_id", fn.first_match(title, HEADLINES, "UNKNOWN").alias("label"))


#: kind of a fact, the phrase it is stated in, and the group that holds its number
FACTS = [
    ("PER_SHARE_CENTS", r"([0-9]+(?:\.[0-9]+)?) cents per share", 1),
    ("MILLIONS", r"([0-9]+(?:\.[0-9]+)?) million dollars", 1),
    ("RANGE_FROM", r"between ([0-9]+(?:\.[0-9]+)?) and ([0-9]+(?:\.[0-9]+)?) million", 1),
    ("RANGE_TO", r"between ([0-9]+(?:\.[0-9]+)?) and ([0-9]+(?:\.[0-9]+)?) million", 2),
    ("PERCENT", r"([0-9]+(?:\.[0-9]+)?) percent", 1),
    ("JOBS", r"([0-9]+) jobs", 1),
]
_FACTS = " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS kind, unnest(generate_series(1, len(v))) AS place, unnest(v) AS value, unnest(w) AS phrase FROM (SELECT doc_id, regexp_extract_all(text, '{p}', {g}) AS v, regexp_extract_all(text, '{p}', 0) AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)" for k, p, g in FACTS
)


def facts(spark: SparkSession, at: str) -> DataFrame:
    """(doc_id, text, kind, place, value, phrase): every statement of every kind in the whole text, in order."""
    d = load(spark, at, "documents", "doc_id", "text").where("text IS NOT NULL AND doc_id IS NOT NULL")
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.arrays_zip(F.regexp_extract_all("text", F.lit(p), F.lit(g)).alias("value"), F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("phrase")).alias("all")) for k, p, g in FACTS])
    kinds = d.withColumn("_k", F.explode(found)).select("doc_id", "text", "_k.*")
    return kinds.select("doc_id", "text", "kind", F.posexplode("all").alias("p", "f")).select("doc_id", "text", "kind", (F.col("p") + 1).alias("place"), F.col("f.value").alias("value"), F.col("f.phrase").alias("phrase"))


@query(f"SELECT doc_id, kind, CAST(place AS INT) AS place, CAST(value AS DOUBLE) AS value FROM ({_FACTS})")
def f12_facts(spark, at):
    """Amounts per share, millions, ranges, percentages and jobs stated in each text."""
    return facts(spark, at).select("doc_id", "kind", "place", F.col("value").cast("double").alias("value"))


@query(f"""WITH f AS ({_FACTS}), k AS (SELECT f.*, strpos(text, phrase) AS start, length(phrase) AS chars, row_number() OVER (PARTITION BY f.doc_id, f.kind, phrase ORDER BY place) AS n, substr(text, strpos(text, phrase), length(phrase)) = phrase AND contains(phrase, value) AS holds FROM f JOIN (SELECT doc_id, text FROM documents) d ON d.doc_id = f.doc_id)
SELECT doc_id, kind, CAST(place AS INT) AS place, CAST(start AS INT) AS start, CAST(chars AS INT) AS chars, CASE WHEN n > 1 THEN 'DUPLICATE' WHEN NOT holds THEN 'NOT_CONTAINED' WHEN kind IN ('RANGE_FROM', 'RANGE_TO') AND chars > 40 THEN 'TOO_LONG' ELSE 'ACCEPTED' END AS outcome FROM k""")
def e24_e25_spans(spark, at):
    """Every claim with the span that is its evidence, read again from the text: accepted once, and only if the span holds the claimed value."""
    f = facts(spark, at).withColumns({"start": F.expr("locate(phrase, text)"), "chars": F.length("phrase")})
    n = F.row_number().over(Window.partitionBy("doc_id", "kind", "phrase").orderBy("place"))
    holds = (F.expr("substring(text, start, chars)") == F.col("phrase")) & F.contains(F.col("phrase"), F.col("value"))
    f = f.withColumns({"holds": holds, "n": n}).drop("text")
    outcome = F.when(F.col("n") > 1, "DUPLICATE").when(~F.col("holds"), "NOT_CONTAINED").when(F.col("kind").isin("RANGE_FROM", "RANGE_TO") & (F.col("chars") > 40), "TOO_LONG").otherwise("ACCEPTED")
    return f.select("doc_id", "kind", "place", "start", "chars", outcome.alias("outcome"))


@query(r"""WITH n AS (SELECT doc_id, trim(ticker) AS t, regexp_replace(coalesce(text, ''), '\s+', ' ', 'g') AS x FROM documents WHERE ticker IS NOT NULL AND trim(ticker) <> '' AND doc_id IS NOT NULL)
SELECT doc_id, CAST(strpos(lower(x), lower(t)) AS INT) AS place, CAST((length(x) - length(replace(x, t, ''))) / length(t) AS INT) AS mentions, CASE WHEN strpos(lower(x), lower(t)) > 0 THEN substr(x, strpos(lower(x), lower(t)), length(t)) END AS quoted FROM n""")
def f14_locate(spark, at):
    """Where a text, its spaces made single, first names its own ticker, how often, and what stands there."""
    n = load(spark, at, "documents", "doc_id", "ticker", "text").where("ticker IS NOT NULL AND trim(ticker) <> '' AND doc_id IS NOT NULL")
    n = n.select("doc_id", F.trim("ticker").alias("t"), F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ").alias("x")).withColumn("place", F.expr("locate(lower(t), lower(x))"))
    return n.select("doc_id", "place", ((F.length("x") - F.length(F.expr("replace(x, t, '')"))) / F.length("t")).cast("int").alias("mentions"), F.when(F.col("place") > 0, F.expr("substring(x, place, length(t))")).alias("quoted"))


_SPEC = "CASE CAST(session_no AS BIGINT) % 7 WHEN 0 THEN {n} || 'D' WHEN 1 THEN {n} || 'm' WHEN 2 THEN ' ' || {n} || 'Y' WHEN 3 THEN 'Today' WHEN 4 THEN 'yesterday' WHEN 5 THEN {iso} ELSE 'soon' END"
_SPEC_SQL = _SPEC.format(n="CAST(CAST(session_no AS BIGINT) % 37 AS VARCHAR)", iso="strftime(session_date - 9, '%Y-%m-%d')")


@query(rf"""WITH s AS (SELECT session_no, session_date AS d, {_SPEC_SQL} AS spec FROM trading_sessions), p AS (SELECT *, lower(trim(spec)) AS x, TRY_CAST(regexp_extract(lower(trim(spec)), '^([0-9]+)[dmy]$', 1) AS INT) AS n, right(lower(trim(spec)), 1) AS u FROM s)
SELECT session_no, spec, strftime(CAST(CASE WHEN x IN ('today', 'now') THEN d WHEN x = 'yesterday' THEN d - 1 WHEN n IS NOT NULL AND u = 'd' THEN d - n WHEN n IS NOT NULL AND u = 'm' THEN d - to_months(n) WHEN n IS NOT NULL THEN d - to_years(n) ELSE TRY_CAST(x AS DATE) END AS DATE), '%Y-%m-%d') AS day FROM p""")
def f08_relative_dates(spark, at):
    """Texts such as 5D, 3m, 2Y, today, yesterday and ISO days, read relative to a day; NULL for what is none of them."""
    n, iso = "CAST(session_no % 37 AS STRING)", "date_format(date_sub(session_date, 9), 'yyyy-MM-dd')"
    s = sessions(spark, at).withColumn("spec", F.expr(_SPEC.format(n=n, iso=iso)))
    return s.select("session_no", "spec", day(fn.parse_date(F.col("spec"), F.col("session_date"))).alias("day"))


@query("""WITH l AS (SELECT doc_id, CAST(timezone('America/New_York', published_at) - INTERVAL 990 MINUTE AS DATE) AS d FROM documents WHERE published_at IS NOT NULL AND doc_id IS NOT NULL)
SELECT doc_id, strftime((SELECT max(session_date) FROM trading_sessions WHERE session_date <= d), '%Y-%m-%d') AS completed FROM l""")
def f09_completed_session(spark, at):
    """The latest session that was over, half an hour after its close in New York, when a document was published."""
    local = F.from_utc_timestamp("published_at", "America/New_York") - F.expr("INTERVAL 990 MINUTES")
    l = load(spark, at, "documents", "doc_id", "published_at").where("published_at IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.to_date(local).alias("day"))
    s = sessions(spark, at)
    days = broadcast_if_bounded(session_of_days(s).join(s, "session_no").select("day", "session_date"), load(spark, at, "trading_sessions"))
    return l.join(days, "day", "left").select("doc_id", day("session_date").alias("completed"))


@query("""WITH n AS (SELECT doc_id, event_date AS e, CAST(published_at AS DATE) AS p FROM documents WHERE doc_id IS NOT NULL), k AS (SELECT *, (SELECT max(session_no) FROM trading_sessions WHERE session_date <= p) - (SELECT max(session_no) FROM trading_sessions WHERE session_date <= e) AS gap FROM n)
SELECT doc_id, CAST(gap AS INT) AS gap, CASE WHEN e IS NULL OR p IS NULL THEN 'UNDATED' WHEN p < e THEN 'FUTURE' WHEN gap IS NULL THEN 'BEFORE_CALENDAR' WHEN gap = 0 THEN 'SAME_SESSION' WHEN gap <= 3 THEN 'RECENT' WHEN gap <= 20 THEN 'AGING' ELSE 'STALE' END AS freshness FROM k""")
def f13_freshness(spark, at):
    """How many sessions lie between an event and the document that reports it, and what that makes of it."""
    n = load(spark, at, "documents", "doc_id", "event_date", "published_at").where("doc_id IS NOT NULL").select("doc_id", F.col("event_date").alias("e"), F.to_date("published_at").alias("p"))
    days = broadcast_if_bounded(session_of_days(sessions(spark, at)).select("day", "session_no"), load(spark, at, "trading_sessions"))
    k = n.join(days.select(F.col("day").alias("e"), F.col("session_no").alias("_e")), "e", "left").join(days.select(F.col("day").alias("p"), F.col("session_no").alias("_p")), "p", "left").withColumn("gap", (F.col("_p") - F.col("_e")).cast("int"))
    gap = F.col("gap")
    label = F.when(F.col("e").isNull() | F.col("p").isNull(), "UNDATED").when(F.col("p") < F.col("e"), "FUTURE").when(gap.isNull(), "BEFORE_CALENDAR").when(gap == 0, "SAME_SESSION").when(gap <= 3, "RECENT").when(gap <= 20, "AGING").otherwise("STALE")
    return k.select("doc_id", "gap", label.alias("freshness"))


_KEY = "sha256(upper(trim(ticker)) || '|' || strftime(event_date, '%Y-%m-%d') || '|' || kind)"
_NORM = r"sha256(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))"


@query(f"""WITH d AS (SELECT doc_id, document_id, published_at, observed_at, {_KEY} AS event_key, {_NORM} AS digest FROM documents WHERE ticker IS NOT NULL AND event_date IS NOT NULL AND kind IS NOT NULL AND observed_at IS NOT NULL),
v AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY observed_at, doc_id) AS revision, lag(digest) OVER (PARTITION BY document_id ORDER BY observed_at, doc_id) AS before FROM d),
e AS (SELECT event_key, count(*) AS members, count(DISTINCT document_id) AS documents, 1 + count(*) FILTER (revision > 1 AND digest <> before) AS generation, max_by(doc_id, (observed_at, doc_id)) AS latest, date_diff('second', min(published_at), min(observed_at)) AS to_seen, date_diff('second', min(observed_at), min(CASE WHEN revision > 1 AND digest <> before THEN observed_at END)) AS to_reopened FROM v GROUP BY 1)
SELECT * FROM e""")
def e09_e13_f15_f16_event_groups(spark, at):
    """Documents grouped by the event they tell of; a revision with another text reopens the event as a new generation; seconds from stage to stage."""
    d = load(spark, at, "documents", "doc_id", "document_id", "ticker", "kind", "event_date", "published_at", "observed_at", "text").where("ticker IS NOT NULL AND event_date IS NOT NULL AND kind IS NOT NULL AND observed_at IS NOT NULL")
    key = F.sha2(F.concat_ws("|", F.upper(F.trim("ticker")), day("event_date"), "kind"), 256)
    d = d.select("doc_id", "document_id", "published_at", "observed_at", key.alias("event_key"), F.sha2(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")), 256).alias("digest"))
    w = Window.partitionBy("document_id").orderBy("observed_at", "doc_id")
    again = F.coalesce((F.row_number().over(w) > 1) & (F.col("digest") != F.lag("digest").over(w)), F.lit(False))
    s = lambda c: F.unix_seconds(F.date_trunc("second", c))
    first = F.min("observed_at")
    return d.withColumn("_again", again).groupBy("event_key").agg(
        F.count(F.lit(1)).alias("members"), F.countDistinct("document_id").alias("documents"), (1 + F.count_if("_again")).alias("generation"), F.max_by("doc_id", F.struct("observed_at", "doc_id")).alias("latest"),
        (s(first) - s(F.min("published_at"))).alias("to_seen"), (s(F.min(F.when(F.col("_again"), F.col("observed_at")))) - s(first)).alias("to_reopened"),
    )


@query("""WITH d AS (SELECT doc_id, upper(trim(ticker)) AS t, event_date AS e, published_at, observed_at, source, text FROM documents WHERE doc_id IS NOT NULL), b AS (SELECT DISTINCT upper(trim(ticker)) AS t, date AS e FROM coverage_bars WHERE isfinite(close) AND close > 0), q AS (SELECT DISTINCT upper(trim(ticker)) AS t, date AS e FROM bar_quarantine),
m AS (SELECT upper(trim(current_ticker)) AS t, max_by(trim(name), (updated_at, trim(name))) AS name FROM security_master_snapshots WHERE current_ticker IS NOT NULL AND name IS NOT NULL AND updated_at IS NOT NULL GROUP BY 1)
SELECT doc_id, concat_ws(';', CASE WHEN published_at IS NULL OR observed_at IS NULL THEN 'CLOCK' WHEN observed_at > published_at + INTERVAL 1 HOUR THEN 'LATE' END, CASE WHEN d.e IS NULL THEN 'NO_DATE' END, CASE WHEN m.name IS NULL OR NOT contains(coalesce(text, ''), m.name) THEN 'NO_NAME' END, CASE WHEN b.t IS NULL THEN 'NO_PRICE' END, CASE WHEN coalesce(trim(source), '') = '' THEN 'NO_SOURCE' END, CASE WHEN d.t IS NULL THEN 'NO_TICKER' WHEN NOT contains(coalesce(text, ''), d.t) THEN 'NOT_NAMED' END, CASE WHEN q.t IS NOT NULL THEN 'QUARANTINED' END) AS blockers
FROM d LEFT JOIN b ON b.t = d.t AND b.e = d.e LEFT JOIN q ON q.t = d.t AND q.e = d.e LEFT JOIN m ON m.t = d.t""")
def e14_e19_verification(spark, at):
    """All that keeps a document from being used, in order: clocks, date, company name and ticker in its text, price of its day, source, quarantined price."""
    up = lambda c: F.upper(F.trim(c))
    d = load(spark, at, "documents", "doc_id", "ticker", "event_date", "published_at", "observed_at", "source", "text").where("doc_id IS NOT NULL").select("doc_id", up("ticker").alias("t"), F.col("event_date").alias("e"), "published_at", "observed_at", "source", F.coalesce("text", F.lit("")).alias("x"))
    b = load(spark, at, "coverage_bars", "ticker", "date", "close").where((F.col("close") > 0) & ~F.isnan("close") & (F.col("close") < float("inf"))).select(up("ticker").alias("t"), F.col("date").alias("e"), F.lit(True).alias("_b")).distinct()
    q = load(spark, at, "bar_quarantine", "ticker", "date").select(up("ticker").alias("t"), F.col("date").alias("e"), F.lit(True).alias("_q")).distinct()
    m = load(spark, at, "security_master_snapshots", "current_ticker", "name", "updated_at").dropna().groupBy(up("current_ticker").alias("t")).agg(F.max(F.struct("updated_at", F.trim("name").alias("n"))).alias("m")).select("t", F.col("m.n").alias("name"))
    d = d.join(b, ["t", "e"], "left").join(q, ["t", "e"], "left").join(m, "t", "left")
    codes = [
        F.when(F.col("published_at").isNull() | F.col("observed_at").isNull(), "CLOCK").when(F.col("observed_at") > F.col("published_at") + F.expr("INTERVAL 1 HOUR"), "LATE"),
        F.when(F.col("e").isNull(), "NO_DATE"),
        F.when(F.col("name").isNull() | ~F.contains(F.col("x"), F.col("name")), "NO_NAME"),
        F.when(F.col("_b").isNull(), "NO_PRICE"),
        F.when(F.coalesce(F.trim("source"), F.lit("")) == "", "NO_SOURCE"),
        F.when(F.col("t").isNull(), "NO_TICKER").when(~F.contains(F.col("x"), F.col("t")), "NOT_NAMED"),
        F.when(F.col("_q").isNotNull(), "QUARANTINED"),
    ]
    return d.select("doc_id", F.concat_ws(";", *codes).alias("blockers"))


@query("""WITH d AS (SELECT doc_id, upper(trim(ticker)) AS t, min(observed_at) AS seen FROM documents WHERE ticker IS NOT NULL AND observed_at IS NOT NULL AND doc_id IS NOT NULL GROUP BY ALL), c AS (SELECT t, max(seen) AS through FROM d WHERE seen < TIMESTAMPTZ '2025-07-01 00:00:00+00' GROUP BY 1),
n AS (SELECT d.*, through, row_number() OVER (PARTITION BY d.t ORDER BY seen, doc_id) AS k FROM d LEFT JOIN c USING (t) WHERE seen >= coalesce(through - INTERVAL 24 HOUR, seen) AND seen < TIMESTAMPTZ '2026-01-01 00:00:00+00')
SELECT t AS ticker, doc_id, k, coalesce(seen <= through, false) AS overlap, k <= 5 AS within_budget FROM n""")
def e21_incremental_collection(spark, at):
    """What is collected from each ticker's cursor: a day of overlap before what it has reached, each document once, in order, marked where the budget of a round ends."""
    d = load(spark, at, "documents", "doc_id", "ticker", "observed_at").dropna().groupBy("doc_id", F.upper(F.trim("ticker")).alias("t")).agg(F.min("observed_at").alias("seen"))
    c = d.where("seen < timestamp'2025-07-01 00:00:00'").groupBy("t").agg(F.max("seen").alias("through"))
    n = d.join(c, "t", "left").where((F.col("seen") >= F.coalesce(F.col("through") - F.expr("INTERVAL 24 HOURS"), F.col("seen"))) & F.expr("seen < timestamp'2026-01-01 00:00:00'"))
    k = F.row_number().over(Window.partitionBy("t").orderBy("seen", "doc_id"))
    return n.withColumn("k", k).select(F.col("t").alias("ticker"), "doc_id", "k", F.coalesce(F.col("seen") <= F.col("through"), F.lit(False)).alias("overlap"), (F.col("k") <= 5).alias("within_budget"))


@query(f"""WITH {PANEL_SQL}, f AS (SELECT security_id, session_no, close / nullif(lag(close, 20) {LAG}, 0) - 1 AS mom, CASE WHEN lead(close, 20) {LAG} > 0 AND close > 0 THEN lead(close, 20) {LAG} / close - 1 END AS nxt FROM panel), k AS (SELECT *, rank() OVER (PARTITION BY session_no ORDER BY mom DESC) AS rank, row_number() OVER (PARTITION BY session_no ORDER BY mom, security_id) AS rn, count(*) OVER (PARTITION BY session_no) AS n FROM f WHERE mom IS NOT NULL AND session_no % 20 = 0),
g AS (SELECT *, CAST(greatest(1, ceil((rn - 1) * 5.0 / greatest(n - 1, 1))) AS INT) AS grp FROM k WHERE n >= 5), w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY session_no, grp) AS weight FROM g)
SELECT w.session_no, w.security_id, {r('w.mom', 'score')}, w.rank, w.grp, {r('b.weight', 'held_weight')}, {r('w.weight', 'target_weight')}, {r('w.weight * w.nxt', 'contribution')}, concat_ws(';', CASE WHEN b.grp IS NULL THEN 'NEW' WHEN b.grp <> w.grp THEN 'MOVED' ELSE 'KEPT' END, CASE WHEN w.nxt IS NULL THEN 'NO_OUTCOME' END) AS reasons FROM w LEFT JOIN w b ON b.security_id = w.security_id AND b.session_no = w.session_no - 20""")
def l18_decision_replay(spark, at):
    """Every decision: score, rank and group of a security, its weight before and after, what it contributed to its group, and why."""
    df = panel(spark, at, "close")
    w = S.by_security()
    nxt = F.lead("close", 20).over(w)
    f = df.withColumns({"mom": S.change("close", 20), "nxt": F.when((nxt > 0) & (F.col("close") > 0), nxt / F.col("close") - 1)}).where("mom IS NOT NULL AND session_no % 20 = 0")
    from tidemark.operators import xsec

    g = f.withColumns({"rank": F.rank().over(Window.partitionBy("session_no").orderBy(F.col("mom").desc())), "grp": xsec.quantile_groups("mom", ["session_no"], "security_id")}).where("grp IS NOT NULL")
    g = g.withColumn("weight", 1 / F.count(F.lit(1)).over(Window.partitionBy("session_no", "grp"))).select("session_no", "security_id", "mom", "nxt", "rank", "grp", "weight")
    b = g.select((F.col("session_no") + 20).alias("session_no"), "security_id", F.col("grp").alias("_g"), F.col("weight").alias("_w"))
    moved = F.when(F.col("_g").isNull(), "NEW").when(F.col("_g") != F.col("grp"), "MOVED").otherwise("KEPT")
    return g.join(b, ["session_no", "security_id"], "left").select("session_no", "security_id", r6(F.col("mom")).alias("score"), "rank", "grp", r6(F.col("_w")).alias("held_weight"), r6(F.col("weight")).alias("target_weight"), r6(F.col("weight") * F.col("nxt")).alias("contribution"), F.concat_ws(";", moved, F.when(F.col("nxt").isNull(), "NO_OUTCOME")).alias("reasons"))


_L18 = ORACLES["l18_decision_replay"]


@query(f"WITH d AS ({_L18}) SELECT * FROM d WHERE session_no = 300 AND reasons NOT LIKE 'KEPT%'")
def l19_replay_of_a_date(spark, at):
    """The decisions of one date that changed something (a report of one date)."""
    return l18_decision_replay(spark, at).where("session_no = 300 AND reasons NOT LIKE 'KEPT%'")


@query(f"WITH d AS ({_L18}) SELECT d.* FROM d WHERE security_id IN (SELECT security_id FROM coverage_bars WHERE upper(trim(ticker)) = 'QBMK')")
def l20_replay_of_a_security(spark, at):
    """The decisions on one security over time (a report of one security)."""
    one = load(spark, at, "coverage_bars", "security_id", "ticker").where(F.upper(F.trim("ticker")) == "QBMK").select("security_id").distinct()
    return l18_decision_replay(spark, at).join(one, "security_id", "left_semi").select("session_no", "security_id", "score", "rank", "grp", "held_weight", "target_weight", "contribution", "reasons")


@query(f"""WITH {BARS_SQL}, d AS (SELECT security_id, session_no, close, adj_close / close AS f, lag(close) {LAG} AS pc, lag(adj_close / close) {LAG} AS pf FROM bars WHERE close > 0 AND adj_close > 0), x AS (SELECT security_id, session_no AS ex, pc * (1 - pf / f) AS amount FROM d WHERE pf > 0 AND pc > 0 AND pf / f < 1 - 1e-4 AND pf / f > 0.8),
s AS (SELECT session_no AS b FROM trading_sessions WHERE session_no % 20 = 0), p AS (SELECT b.security_id, b.session_no, close FROM bars b JOIN s ON s.b = b.session_no WHERE close > 0)
SELECT x.security_id, CAST(x.ex AS INT) AS ex, floor(10000 / p.close) AS shares, round(amount, 5) + 0.0 AS amount, round(floor(10000 / p.close) * amount, 2) + 0.0 AS cash, sha256(x.security_id || '|' || CAST(x.ex AS VARCHAR)) AS event_id FROM x JOIN p ON p.security_id = x.security_id AND p.session_no = ((x.ex - 1) // 20) * 20""")
def l16_dividend_events(spark, at):
    """Cash of implied distributions: the shares bought at the last trade strictly before the ex day times the amount, with an id that is the same whenever it is made."""
    b = bars(spark, at, "close", "adj_close")
    w = S.by_security()
    d = b.where("close > 0 AND adj_close > 0").withColumn("f", F.col("adj_close") / F.col("close")).withColumns({"pc": F.lag("close").over(w), "pf": F.lag("f").over(w)})
    x = d.where("pf > 0 AND pc > 0 AND pf / f < 1 - 1e-4 AND pf / f > 0.8").select("security_id", F.col("session_no").alias("ex"), (F.col("pc") * (1 - F.col("pf") / F.col("f"))).alias("amount"))
    x = x.withColumn("session_no", (F.floor((F.col("ex") - 1) / 20) * 20).cast("int"))
    p = b.where("close > 0 AND session_no % 20 = 0").select("security_id", "session_no", F.floor(10000 / F.col("close")).cast("double").alias("shares"))
    return x.join(p, ["security_id", "session_no"]).select("security_id", "ex", "shares", (F.round("amount", 5) + 0.0).alias("amount"), (F.round(F.col("shares") * F.col("amount"), 2) + 0.0).alias("cash"), F.sha2(F.concat_ws("|", "security_id", F.col("ex").cast("string")), 256).alias("event_id"))


@query(f"""WITH {PANEL_SQL}, f AS (SELECT *, lag(close) {LAG} AS base, open / nullif(lag(close) {LAG}, 0) - 1 AS gap, volume / nullif(avg(volume) OVER w, 0) AS rvol, max(high) OVER w AS top, CASE WHEN count(close) OVER v = 10 THEN avg(close) OVER v END AS m10, CASE WHEN count(close) OVER u = 20 THEN avg(close) OVER u END AS m20 FROM panel WINDOW w AS (PARTITION BY security_id ORDER BY session_no ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), v AS (PARTITION BY security_id ORDER BY session_no ROWS 9 PRECEDING), u AS (PARTITION BY security_id ORDER BY session_no ROWS 19 PRECEDING))
SELECT security_id, session_no, CASE WHEN base IS NULL THEN 'NO_BASELINE' WHEN open IS NULL THEN 'STALE' WHEN coalesce(volume, 0) = 0 THEN 'HALTED' WHEN abs(gap) >= 0.03 THEN 'GAP' ELSE 'QUIET' END AS status, {r('gap', 'gap')}, {r('rvol', 'relative_volume')}, coalesce(close > top AND m10 > m20, false) AS breakout,
  CASE WHEN gap >= 0.06 AND rvol >= 2 AND close > open THEN 'STRONG' WHEN gap >= 0.04 AND rvol >= 1.5 THEN 'MODERATE' WHEN gap >= 0.03 THEN 'WATCH' WHEN gap >= 0.02 THEN 'HEADS_UP' END AS grade FROM f""")
def st11_st15_st23_signals(spark, at):
    """Status of each session's price against its baseline, gap and relative volume, the breakout above the pivot with aligned averages, and the grade."""
    w = S.by_security()
    past = w.rowsBetween(-20, -1)
    f = panel(spark, at, "open", "high", "close", "volume").withColumns({
        "base": F.lag("close").over(w), "rvol": S.ratio(F.col("volume"), F.avg("volume").over(past)), "pivot": F.max("high").over(past), "m10": S.full(F.avg("close"), "close", 10), "m20": S.full(F.avg("close"), "close", 20),
    }).withColumn("gap", S.ratio(F.col("open"), F.col("base")) - 1)
    gap, rvol = F.col("gap"), F.col("rvol")
    status = F.when(F.col("base").isNull(), "NO_BASELINE").when(F.col("open").isNull(), "STALE").when(F.coalesce("volume", F.lit(0.0)) == 0, "HALTED").when(F.abs(gap) >= 0.03, "GAP").otherwise("QUIET")
    grade = F.when((gap >= 0.06) & (rvol >= 2) & (F.col("close") > F.col("open")), "STRONG").when((gap >= 0.04) & (rvol >= 1.5), "MODERATE").when(gap >= 0.03, "WATCH").when(gap >= 0.02, "HEADS_UP")
    return f.select("security_id", "session_no", status.alias("status"), r6(gap).alias("gap"), r6(rvol).alias("relative_volume"), F.coalesce((F.col("close") > F.col("pivot")) & (F.col("m10") > F.col("m20")), F.lit(False)).alias("breakout"), grade.alias("grade"))


_RANK = "CASE WHEN value >= 150 THEN 3 WHEN value >= 100 THEN 2 WHEN value >= 50 THEN 1 ELSE 0 END"


@query(f"""WITH e AS (SELECT *, {_RANK} AS rank FROM events), s AS (SELECT *, max(rank) OVER w AS seen, max(CASE WHEN event_type <> 'error' THEN rank END) OVER w AS delivered FROM e WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, rank, coalesce(seen, -1) AS seen, coalesce(delivered, -1) AS delivered, CASE WHEN delivered IS NULL THEN 'UNDELIVERED' ELSE 'UPGRADED' END AS why FROM s WHERE delivered IS NULL OR rank > delivered""")
def st20_state_diff(spark, at):
    """Events that are to be sent: nothing of their user and day has been delivered yet, or their rank is above all that has. A failed event counts as seen, not as delivered."""
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = load(spark, at, "events", "event_id", "user_id", "ts", "event_type", "value").withColumn("rank", F.expr(_RANK))
    s = e.withColumns({"seen": F.max("rank").over(w), "delivered": F.max(F.when(F.col("event_type") != "error", F.col("rank"))).over(w)}).where("delivered IS NULL OR rank > delivered")
    return s.select("event_id", "rank", F.coalesce("seen", F.lit(-1)).alias("seen"), F.coalesce("delivered", F.lit(-1)).alias("delivered"), F.when(F.col("delivered").isNull(), "UNDELIVERED").otherwise("UPGRADED").alias("why"))


@query("""WITH p AS (SELECT *, max(value) OVER w AS top, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), h AS (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS k FROM p WHERE n >= 2 AND value > top * 1.05)
SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id, n AS before FROM h WHERE k = 1""")
def st21_prefix_replay(spark, at):
    """The first event of each user and day on which a detector fires that sees only what came before it."""
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    p = load(spark, at, "events", "event_id", "user_id", "ts", "value").withColumns({"top": F.max("value").over(past), "n": F.count(F.lit(1)).over(past)}).where("n >= 2 AND value > top * 1.05")
    return p.withColumn("k", F.row_number().over(w)).where("k = 1").select("user_id", day("ts").alias("day"), "event_id", F.col("n").alias("before"))


_FOLD = """e AS (SELECT user_id, CAST(ts AS DATE) AS d, ts, event_id, value, 1 + event_id % 5 AS volume FROM events), f AS (SELECT user_id, d, count(*) AS n, max(value) AS high, min(value) AS low, max_by(value, (ts, event_id)) AS last, sum(volume) AS volume, sum(value * volume) / sum(volume) AS vwap, max(value) FILTER (hour(ts) < 8) AS range_high, min(value) FILTER (hour(ts) < 8) AS range_low, coalesce(sum(volume) FILTER (hour(ts) < 12), 0) AS noon_volume FROM e GROUP BY ALL)"""


@query(f"WITH {_FOLD} SELECT user_id, strftime(d, '%Y-%m-%d') AS day, n, {r('high', 'high')}, {r('low', 'low')}, {r('last', 'last')}, CAST(volume AS BIGINT) AS volume, {r('vwap', 'vwap')}, {r('range_high', 'range_high')}, {r('range_low', 'range_low')}, CAST(noon_volume AS BIGINT) AS noon_volume FROM f")
def st04_st06_session_fold_stream(spark, at):
    """The session fold as a stream: high, low, last, volume, weighted price, opening range and the volume profile per user and day, kept as state. A row delivered again, or late, is put in its place and the day is folded anew."""
    events = stream.stream_table(spark, at, "events", delivered=True).select("event_id", "user_id", "ts", "value", *stream.DELIVERED).withColumn("volume", 1 + F.col("event_id") % 5).withColumn("day", day("ts"))
    out = stream.run_to_end(stream.session_fold(events, ["user_id", "day"], "event_id", "ts", "value", "volume", 8, 12), ["user_id", "day"], "update", "fold")
    return out.select("user_id", "day", "n", *[r6(F.col(c)).alias(c) for c in ("high", "low", "last")], "volume", *[r6(F.col(c)).alias(c) for c in ("vwap", "range_high", "range_low")], "noon_volume")
