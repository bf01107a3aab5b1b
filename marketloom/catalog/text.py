"""Text and mention queries over posts, articles and filings derived from the raw tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import words as wd
from ..functions.numeric import col
from ..operators import mentions as mn
from ..operators import news as nw
from .base import add_base, query

AS_OF = "2024-01-03"
AT = f"TIMESTAMP '{AS_OF}'"


def quoted(xs):
    return ", ".join(f"'{x}'" for x in xs)


def hits(text, weights):
    """Per-word counting: one extract per word, unlike the single alternation of the Spark side."""
    return " + ".join(rf"len(regexp_extract_all(lower({text}), '\b{k}\b')) * {float(v)}" for k, v in weights.items())


def emoji(text, weights):
    return " + ".join(f"((length({text}) - length(replace({text}, '{k}', ''))) / {len(k)}) * {v}"
                      for k, v in weights.items())


add_base("tickers", rf"""SELECT id, list_filter(list_distinct(regexp_extract_all("text", '\$([A-Z]{{1,5}})\b', 1) ||
    list_transform(regexp_extract_all("text", '(?i)\b({'|'.join(wd.CRYPTO)})\b', 1), lambda x: upper(x))),
    lambda x: NOT list_contains([{quoted(wd.NOT_TICKERS)}], x)) AS tickers FROM posts""")
add_base("scored_posts", f"""SELECT *, ({hits('"text"', wd.MOMENTUM)}) * greatest(ln(1 + score + comments) / 3, 0.5)
    AS momentum FROM posts""")
add_base("mentions", """SELECT id, author, subreddit, score, comments, ts, unnest(tickers) AS symbol, momentum
    FROM scored_posts JOIN tickers USING (id)""")


@query("text_mentions_symbol", "id:i symbol", r"""SELECT DISTINCT id, s AS symbol FROM posts,
    (SELECT unnest(['AAPL', 'TSLA', 'GME', 'MOON', 'BANK']) AS s)
    WHERE list_contains(regexp_extract_all(upper("text"), '([A-Z0-9]+)', 1), s)""")
def _mentions_symbol(m):
    syms = m.spark.createDataFrame([(s,) for s in ("AAPL", "tsla", "GME", "MOON", "BANK")], "symbol string")
    return mn.mentions_symbol(m.posts(), syms)


@query("text_extract_tickers", "id:i symbol", "SELECT id, unnest(tickers) AS symbol FROM tickers")
def _tickers(m):
    return mn.extract_tickers(m.posts()).select("id", F.explode("tickers").alias("symbol"))


# Word boundaries of the query hold for letters, digits and marks of every script; RE2 knows ASCII alone, so others become "_".
_plain = "replace(regexp_replace(\"text\", '" + "|".join(rf"[^\x00-\x7F\P{{{c}}}]" for c in ("L", "Nd", "Mn")) + "', '_', 'g'), chr(11), ' ')"
_pats = " || ".join(f"regexp_extract_all(plain, '{p}', 1)" for p in wd.SYMBOL_PATTERNS)
_ctx = " + ".join(f"CAST(contains(lower(\"text\"), '{w}') AS INT)" for w in wd.CONTEXT_WORDS)


@query("text_extract_symbols_scored", "id:i symbol confidence:d", f"""
    SELECT * FROM (SELECT id, symbol, least(0.5 + (CASE WHEN symbol IN ({quoted(wd.KNOWN_TICKERS)}) THEN 0.3 ELSE 0 END) +
      least(ctx * 0.05, 0.2) + (CASE WHEN contains("text", '$' || symbol) THEN 0.2 ELSE 0 END) -
      (CASE WHEN length(symbol) = 2 THEN 0.1 ELSE 0 END), 1) AS confidence
    FROM (SELECT id, "text", {_ctx} AS ctx, unnest(list_distinct({_pats})) AS symbol FROM (SELECT *, {_plain} AS plain FROM posts))
    WHERE length(symbol) BETWEEN 2 AND 5 AND symbol NOT IN ({quoted(wd.NOT_TICKERS)})) WHERE confidence > 0.3""")
def _scored(m):
    return mn.extract_symbols_scored(m.posts())


_emo = {"bullish": emoji('"text"', wd.BULLISH_EMOJI), "bearish": emoji('"text"', wd.BEARISH_EMOJI),
        "rockets": emoji('"text"', {"🚀": 1}), "diamonds": emoji('"text"', {"💎": 1})}


@query("text_emoji_signals", "subreddit bullish:d bearish:d rockets:i diamonds:i net_signal:d", f"""
    SELECT subreddit, sum(b) AS bullish, sum(s) AS bearish, sum(r) AS rockets, sum(d) AS diamonds,
    (sum(b) - sum(s)) / greatest(sum(b) + sum(s), 1) AS net_signal FROM (SELECT subreddit, {_emo['bullish']} AS b,
    {_emo['bearish']} AS s, {_emo['rockets']} AS r, {_emo['diamonds']} AS d FROM posts) GROUP BY 1""")
def _emoji(m):
    return mn.emoji_summary(mn.emoji_signals(m.posts()), ["subreddit"])


_opt = " + ".join(rf"len(regexp_extract_all(lower(plain), '\b{w}\b'))" for w in wd.OPTION_WORDS)


@query("text_option_signals", "subreddit calls:i puts:i yolo:i option_words:i activity:i call_put_ratio:d options_bias:d",
       rf"""SELECT *, calls + puts AS activity, calls / greatest(puts, 1) AS call_put_ratio,
    (calls - puts) / greatest(calls + puts, 1) AS options_bias FROM (SELECT subreddit,
    sum(len(regexp_extract_all(plain, '(?i)\bcalls?\b'))) AS calls,
    sum(len(regexp_extract_all(plain, '(?i)\bputs?\b'))) AS puts, sum(len(regexp_extract_all(plain, '(?i)\byolo\b'))) AS yolo,
    sum({_opt}) AS option_words FROM (SELECT subreddit, {_plain} AS plain FROM posts) GROUP BY 1)""")
def _options(m):
    return mn.option_summary(mn.option_signals(m.posts()), ["subreddit"])


_titled = "concat_ws(' ', title, \"text\")"


@query("text_is_dd", "subreddit n:i", "SELECT subreddit, count(*) AS n FROM posts WHERE " + " OR ".join(
    f"contains(lower(title), '{w}')" for w in wd.DD_TITLE_WORDS + ("valuation",)) + " GROUP BY 1")
def _dd(m):
    p = mn.is_dd(m.posts())
    return p.filter(col("is_dd") | F.lower("title").contains("valuation")).groupBy("subreddit").agg(
        F.count(F.lit(1)).alias("n"))


@query("text_dd_quality", "subreddit dd_count:i avg_dd_quality:d high:i medium:i low:i", f"""
    SELECT subreddit, count(*) AS dd_count, avg(q) AS avg_dd_quality, count(*) FILTER (q > 10) AS high,
    count(*) FILTER (q > 5 AND q <= 10) AS medium, count(*) FILTER (q <= 5) AS low FROM (SELECT subreddit,
    ({hits(_titled, wd.DD_WORDS)}) * ln(1 + score + comments) / 5 AS q FROM posts) GROUP BY 1""")
def _ddq(m):
    return mn.dd_summary(mn.dd_quality(m.posts()), ["subreddit"])


_kw = " + ".join(f"CAST(contains(lower(\"text\"), '{w}') AS INT)" for w in wd.DD_SHORT_WORDS)


@query("text_dd_quality_v2", "id:i word_count:i dd_words:i dd_quality_text:d", rf"""SELECT id, word_count, dd_words,
    least(word_count / 1000, 1) * 0.3 + CASE WHEN regexp_matches("text", '\d+') THEN 0.2 ELSE 0 END +
    CASE WHEN regexp_matches("text", 'https?://') THEN 0.1 ELSE 0 END + dd_words / 6 * 0.2 AS dd_quality_text
    FROM (SELECT *, len(regexp_split_to_array(regexp_replace("text", '^ +| +$', '', 'g'), '[ \t\n\x0B\f\r]+'))
    AS word_count, {_kw} AS dd_words FROM posts)""")
def _ddq2(m):
    return mn.dd_quality_text(m.posts())


@query("text_momentum_keywords", "subreddit momentum_score:d items:i high_conviction:i strength direction", """
    SELECT *, CASE WHEN momentum_score > 2 THEN 'very_strong' WHEN momentum_score > 1 THEN 'strong'
    WHEN momentum_score > 0.3 THEN 'moderate' WHEN momentum_score > -0.3 THEN 'weak' ELSE 'negative' END AS strength,
    CASE WHEN momentum_score > 0 THEN 'bullish' ELSE 'bearish' END AS direction FROM (SELECT subreddit,
    avg(momentum) AS momentum_score, count(*) AS items, count(*) FILTER (abs(momentum) > 5) AS high_conviction
    FROM scored_posts GROUP BY 1)""")
def _momentum(m):
    return mn.momentum_summary(mn.momentum_score(m.posts()), ["subreddit"])


_lex = f"(exp(2 * x) - 1) / (exp(2 * x) + 1)"
add_base("lexicon", f"""SELECT *, CASE WHEN s > 0.1 THEN 'positive' WHEN s < -0.1 THEN 'negative' ELSE 'neutral' END AS
    label, least(0.5 + abs(s) / 2, 1) AS confidence FROM (SELECT *, CASE WHEN x > 20 THEN 1.0 WHEN x < -20 THEN -1.0
    ELSE {_lex} END AS s FROM (SELECT *, ({hits('"text"', wd.MOMENTUM)}) / 5 AS x FROM posts))""")


@query("text_sentiment_lexicon", "id:i sentiment:d label confidence:d",
       "SELECT id, s AS sentiment, label, confidence FROM lexicon")
def _lexicon(m):
    return mn.lexicon_sentiment(m.posts())


def length_scorer():
    """A stand-in model: label by the parity of the text length, score by its magnitude."""
    def score(texts):
        return [("positive" if len(t) % 2 else "negative", min(len(t) / 5000, 1.0)) for t in texts]
    return score


@query("text_sentiment_model_hook", "id:i label sentiment:d", """SELECT id, CASE WHEN length("text") % 2 = 1 THEN 'positive'
    ELSE 'negative' END AS label, least(length("text") / 5000, 1) * (CASE WHEN length("text") % 2 = 1 THEN 1 ELSE -1 END)
    AS sentiment FROM posts""")
def _model(m):
    return mn.model_sentiment(m.posts(), length_scorer)


def _weighted(m):
    p = mn.is_dd(mn.lexicon_sentiment(m.posts()))
    return p.withColumns({"is_comment": col("id") % 3 == 0, "credibility": F.least(col("score") / 1000, F.lit(1.0)),
                          "engagement_weight": F.log1p(col("comments").cast("double"))})


_dd_sql = " OR ".join(f"contains(lower(title), '{w}')" for w in wd.DD_TITLE_WORDS)


@query("text_weighted_post_sentiment", "subreddit weighted:d ratio:d confidence:d", f"""
    SELECT subreddit, avg(s * w) AS weighted, sum(s * w) / nullif(sum(w), 0) AS ratio, avg(confidence) AS confidence
    FROM (SELECT *, ln(1 + comments) * least(score / 1000, 1) * confidence * (CASE WHEN id % 3 = 0 THEN 0.5
    WHEN {_dd_sql} THEN 2 ELSE 1 END) AS w FROM lexicon) GROUP BY 1""")
def _wps(m):
    return mn.weighted_post_sentiment(_weighted(m), ["subreddit"])


@query("text_sentiment_distribution", "subreddit positive:d negative:d neutral:d", """SELECT subreddit,
    count(*) FILTER (label = 'positive') / count(*) AS positive, count(*) FILTER (label = 'negative') / count(*)
    AS negative, count(*) FILTER (label = 'neutral') / count(*) AS neutral FROM lexicon GROUP BY 1""")
def _dist(m):
    return mn.sentiment_distribution(mn.lexicon_sentiment(m.posts()), ["subreddit"])


@query("text_engagement", "symbol total_engagement:i avg_engagement:d unique_users:i", """SELECT symbol,
    sum(score + comments) AS total_engagement, avg(score + comments) AS avg_engagement,
    count(DISTINCT author) AS unique_users FROM mentions GROUP BY 1""")
def _engagement(m):
    return mn.engagement(m.mentions(), ["symbol"])


@query("text_viral_posts", "subreddit id:i score:i", """SELECT p.subreddit, id, score FROM posts p JOIN (SELECT subreddit,
    quantile_cont(score, 0.9) AS p90 FROM posts GROUP BY 1) q USING (subreddit) WHERE score >= greatest(p90, 1000)""")
def _viral(m):
    return mn.viral_posts(m.posts(), ["subreddit"])


@query("text_user_credibility", "author credibility:d", """SELECT author, least(k * 13 / 10000, 1) * 0.3 +
    least(n * 211 / 5000, 1) * 0.2 + least(n * 37 / 365, 1) * 0.2 + least(a / 100, 1) * 0.15 + least(c / 10, 1) * 0.15
    AS credibility FROM (SELECT author, sum(comments) AS k, count(*) AS n, avg(score) / 20 AS a, avg(comments) / 30 AS c
    FROM posts GROUP BY 1)""")
def _credibility(m):
    u = m.posts().groupBy("author").agg(
        (F.sum("comments") * 13).alias("comment_karma"), (F.count(F.lit(1)) * 211).alias("link_karma"),
        (F.count(F.lit(1)) * 37).alias("age_days"), (F.avg("score") / 20).alias("avg_post_score"),
        (F.avg("comments") / 30).alias("avg_comment_score"))
    return mn.user_credibility(u)


add_base("cred", """SELECT symbol, avg(c) AS avg_credibility, var_pop(c) AS credibility_variance,
    count(*) FILTER (c > 0.7) / count(*) AS high_share, sum(s * c) / greatest(sum(c), 1) AS weighted_sentiment
    FROM (SELECT symbol, least(score / 1000, 1) AS c, CASE WHEN momentum > 100 THEN 1 WHEN momentum < -100 THEN -1 ELSE
    (exp(2 * momentum / 5) - 1) / (exp(2 * momentum / 5) + 1) END AS s FROM mentions) GROUP BY 1""")
add_base("cred_class", """SELECT *, CASE WHEN avg_credibility > 0.7 AND high_share > 0.3 THEN 'very_high'
    WHEN avg_credibility > 0.6 AND high_share > 0.2 THEN 'high' WHEN avg_credibility > 0.5 THEN 'medium' ELSE 'low' END
    AS reliability FROM cred""")


@query("text_credibility_distribution",
       "symbol avg_credibility:d credibility_variance:d high_share:d weighted_sentiment:d reliability",
       "SELECT * FROM cred_class")
def _cred_dist(m):
    c = m.mentions().withColumns({"credibility": F.least(col("score") / 1000, F.lit(1.0)),
                                  "sentiment": F.tanh(col("momentum") / 5)})
    return mn.credibility_distribution(c, ["symbol"])


add_base("velocity", """SELECT symbol, avg(n) AS per_hour, count(*) AS hours, arg_max(n, bucket) AS current,
    max(n) AS peak, arg_max(bucket, n * 1e7 - epoch(bucket) / 1e7) AS peak_hour,
    CASE WHEN count(*) < 2 THEN 0 ELSE (avg(n) FILTER (r <= 3) - coalesce(avg(n) FILTER (r > 3), arg_min(n, bucket))) /
    greatest(coalesce(avg(n) FILTER (r > 3), arg_min(n, bucket)), 1) END AS acceleration
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bucket DESC) AS r FROM (
    SELECT symbol, date_trunc('hour', ts) AS bucket, count(*) AS n FROM mentions GROUP BY 1, 2)) GROUP BY 1""")
add_base("velocity_class", """SELECT *, CASE WHEN acceleration > 0.5 THEN 'accelerating' WHEN acceleration < -0.3 THEN
    'decelerating' ELSE 'stable' END AS trend FROM velocity""")


@query("text_mention_velocity", "symbol per_hour:d hours:i current:i peak:i peak_hour acceleration:d trend",
       "SELECT * FROM velocity_class")
def _velocity(m):
    return mn.mention_velocity(m.mentions(), ["symbol"])


@query("text_mention_velocity_12h", "symbol velocity_12h:i", f"""SELECT symbol, greatest(2 * count(*) FILTER (
    ts > {AT} - INTERVAL 12 HOUR AND ts <= {AT}) - count(*) FILTER (ts > {AT} - INTERVAL 24 HOUR AND ts <= {AT}), 0)
    AS velocity_12h FROM mentions GROUP BY 1""")
def _velocity12(m):
    return mn.mention_velocity_12h(m.mentions(), ["symbol"], AS_OF)


@query("text_trending_symbols", "symbol n:i engagement:i subs:i trend_score:d avg_engagement:d", """SELECT symbol,
    count(*) AS n, sum(score) AS engagement, count(DISTINCT subreddit) AS subs,
    count(*) * count(DISTINCT subreddit) * ln(1 + sum(score)) AS trend_score, sum(score) / count(*) AS avg_engagement
    FROM mentions GROUP BY 1 HAVING count(*) >= 3 ORDER BY trend_score DESC, symbol LIMIT 10""")
def _trending(m):
    return mn.trending_symbols(m.mentions())


@query("text_ticker_sentiment_emoji", "symbol sentiment:d confidence:d mentions:i bullish:d bearish:d", f"""
    SELECT symbol, sum(s * w) / greatest(sum(w), 1) AS sentiment, least(count(*) / 20, 1) AS confidence,
    count(*) AS mentions, sum(b) AS bullish, sum(e) AS bearish FROM (SELECT symbol, 1 + score / 100 AS w, b, e,
    (b - e) / greatest(b + e, 1) * 0.7 + CASE WHEN score > 0 THEN 0.3 ELSE -0.3 END AS s FROM mentions JOIN (SELECT id,
    {_emo['bullish']} AS b, {_emo['bearish']} AS e FROM posts) USING (id)) GROUP BY 1""")
def _ticker_emoji(m):
    p = mn.emoji_signals(m.posts()).select("id", "bullish", "bearish")
    return mn.ticker_sentiment_emoji(m.mentions().join(p, "id"), ["symbol"])


add_base("profile", f"""SELECT * FROM velocity_class JOIN cred_class USING (symbol) JOIN (SELECT symbol,
    avg(momentum) AS momentum_score, count(*) FILTER (abs(momentum) > 5) AS high_conviction,
    sum(score + comments) AS total_engagement, sum(b) AS bullish, sum(r) AS rockets, sum(c + p) AS activity FROM mentions
    JOIN (SELECT id, {_emo['bullish']} AS b, {_emo['rockets']} AS r,
      len(regexp_extract_all("text", '(?i)\\bcalls?\\b')) AS c, len(regexp_extract_all("text", '(?i)\\bputs?\\b')) AS p
      FROM posts) USING (id) GROUP BY 1) USING (symbol)""")
add_base("profile_class", """SELECT *, CASE WHEN momentum_score > 2 THEN 'very_strong' WHEN momentum_score > 1 THEN 'strong'
    WHEN momentum_score > 0.3 THEN 'moderate' WHEN momentum_score > -0.3 THEN 'weak' ELSE 'negative' END AS strength
    FROM profile""")


@query("text_social_alerts", "symbol type priority confidence:d rank:i", """SELECT *, row_number() OVER (PARTITION BY symbol
    ORDER BY priority, confidence DESC, type) AS rank FROM (
    SELECT symbol, 'VELOCITY_SPIKE' AS type, 'HIGH' AS priority, CASE trend WHEN 'accelerating' THEN 0.9 ELSE 0.7 END AS
      confidence FROM profile_class WHERE per_hour > 3 UNION ALL
    SELECT symbol, 'MOMENTUM_SURGE', CASE WHEN strength IN ('strong', 'very_strong') THEN 'HIGH' ELSE 'MEDIUM' END,
      CASE WHEN high_conviction > 2 THEN 0.95 ELSE 0.8 END FROM profile_class WHERE abs(momentum_score) > 2 UNION ALL
    SELECT symbol, 'HIGH_CREDIBILITY_SIGNAL', 'MEDIUM', avg_credibility FROM profile_class
      WHERE reliability IN ('high', 'very_high') AND avg_credibility > 0.6 UNION ALL
    SELECT symbol, 'MEME_STOCK_ACTIVITY', 'MEDIUM', 0.7 FROM profile_class WHERE rockets > 10 OR bullish > 20 UNION ALL
    SELECT symbol, 'OPTIONS_FLOW_SURGE', 'MEDIUM', 0.8 FROM profile_class WHERE activity > 10)""")
def _alerts(m):
    return mn.social_alerts(mn.symbol_profile(m.mentions(), m.posts()))


@query("text_risk_adjusted_sentiment", "symbol factor:d risk_adjusted:d confidence_level:d", """SELECT symbol, factor,
    least(greatest(weighted_sentiment * factor, -1), 1) AS risk_adjusted, avg_credibility * factor AS confidence_level
    FROM (SELECT *, least(greatest((CASE reliability WHEN 'very_high' THEN 1.2 WHEN 'high' THEN 1.1 WHEN 'low' THEN 0.7
    ELSE 1 END) * (CASE trend WHEN 'accelerating' THEN 1.15 WHEN 'decelerating' THEN 0.9 ELSE 1 END) * (CASE strength
    WHEN 'very_strong' THEN 1.2 WHEN 'strong' THEN 1.1 WHEN 'weak' THEN 0.8 ELSE 1 END) * (CASE WHEN total_engagement >
    10000 THEN 1.1 WHEN total_engagement < 1000 THEN 0.9 ELSE 1 END), 0.5), 2) AS factor FROM profile_class)""")
def _risk_adj(m):
    return mn.risk_adjusted_sentiment(mn.symbol_profile(m.mentions(), m.posts()))


@query("text_clean", "id:i h", r"""SELECT id, md5(trim(regexp_replace(regexp_replace(regexp_replace("text",
    'https?://[^ \t\n\x0B\f\r]+|www\.[^ \t\n\x0B\f\r]+', '', 'g'), '[@#][a-zA-Z_0-9]+', '', 'g'), '[ \t\n\x0B\f\r]+',
    ' ', 'g'))) AS h FROM posts""")
def _clean(m):
    return m.posts().select("id", F.md5(mn.clean_text("text")).alias("h"))


@query("text_discover_symbols", "symbol n:i mentions:d sentiment:d confidence:d sources:i trending:d final_score:d", f"""
    SELECT * FROM (SELECT *, least(1, least(mentions / 100, 1) + 0.3 * greatest(0, sentiment) + 0.2 * greatest(0,
      1 - epoch({AT} - last_seen) / 86400) + 0.1 * sources / 4 + 0.4 * confidence) AS final_score FROM (
      SELECT symbol, count(*) AS n, sum(v) AS mentions, coalesce(sum(s * c * v) / nullif(sum(c * v), 0), 0) AS sentiment,
        avg(c) AS confidence, count(DISTINCT subreddit) AS sources,
        count(*) FILTER (ts > {AT} - INTERVAL 6 HOUR) / count(*) AS trending, max(ts) AS last_seen
      FROM (SELECT *, comments / 10 AS v, least(0.6 + score / 4000, 1) AS c, CASE WHEN momentum > 0 THEN 1.0 ELSE -0.5 END
        AS s FROM mentions WHERE ts > {AT} - INTERVAL 48 HOUR AND ts <= {AT}) GROUP BY 1))
    WHERE n >= 5 AND mentions >= 50 AND confidence >= 0.7 AND symbol <> 'GME'
    ORDER BY final_score DESC, symbol LIMIT 5""")
def _discover(m):
    d = m.mentions().select(
        "symbol", col("subreddit").alias("source"), "ts", F.when(col("momentum") > 0, 1.0).otherwise(-0.5)
        .alias("sentiment"), F.least(0.6 + col("score") / 4000, F.lit(1.0)).alias("confidence"),
        (col("comments") / 10).alias("volume"))
    held = d.filter("symbol = 'GME'").select("symbol").distinct()
    return mn.discover_symbols(d, held, AS_OF)


@query("text_source_sentiment_average", "lang source positive:d negative:d neutral:d dominant weighted:d", """
    SELECT *, sum((positive - negative) * w) OVER (PARTITION BY lang) / sum(w) OVER (PARTITION BY lang) AS weighted FROM (
    SELECT *, CASE WHEN positive = greatest(positive, negative, neutral) THEN 'positive' WHEN negative =
    greatest(positive, negative, neutral) THEN 'negative' ELSE 'neutral' END AS dominant, CASE source WHEN 'src1' THEN 0.4
    ELSE 0.25 END AS w FROM (SELECT lang, subreddit AS source, avg(CAST(label = 'positive' AS INT)) AS positive,
    avg(CAST(label = 'negative' AS INT)) AS negative, avg(CAST(label = 'neutral' AS INT)) AS neutral FROM lexicon
    GROUP BY 1, 2))""")
def _source_avg(m):
    from pyspark.sql import Window
    p = mn.lexicon_sentiment(m.posts()).withColumn("source", col("subreddit"))
    p = p.withColumns({x: F.when(col("label") == x, 1.0).otherwise(0.0) for x in ("positive", "negative", "neutral")})
    g = nw.source_sentiment_average(p, {"src1": 0.4}, ["lang"])
    w = Window.partitionBy("lang")
    return g.withColumn("weighted", F.sum((col("positive") - col("negative")) * col("w")).over(w) / F.sum("w").over(w))


# ------------------------------------------------------------------ news

_tier = "CASE source WHEN 'reuters' THEN 1.0 WHEN 'cnbc' THEN 0.8 WHEN 'benzinga' THEN 0.6 ELSE 0.4 END"
_imp = " + ".join(f"CAST(contains(t, '{k}') AS INT) * {v}" for k, v in wd.IMPACT.items())
_sec = ", ".join("count(*) FILTER (" + " OR ".join(f"contains(t, '{w}')" for w in ws) + f") / count(*) AS share_{s}"
                 for s, ws in wd.SECTOR_WORDS.items())


@query("news_impact", "source raw_impact:d impact_score:d max_impact:d high_impact:i impact_events:i " + " ".join(
    f"share_{s}:d" for s in wd.SECTOR_WORDS), f"""SELECT source, avg(i) AS raw_impact, least(avg(i) / 10, 1) AS
    impact_score, max(i) AS max_impact, count(*) FILTER (i >= 5) AS high_impact, count(*) FILTER (i >= 3) AS impact_events,
    {_sec} FROM (SELECT *, ({_imp}) * {_tier} AS i FROM (SELECT *, lower(concat_ws(' ', title, summary)) AS t
    FROM articles)) GROUP BY 1""")
def _impact(m):
    return nw.impact_summary(nw.news_impact(m.articles()), ["source"])


@query("news_source_credibility", "source credibility:d", f"SELECT DISTINCT source, {_tier} AS credibility FROM articles")
def _tiering(m):
    return m.articles().select("source", nw.source_credibility().alias("credibility")).distinct()


@query("news_relevance", "id:i symbol relevance:d", """SELECT id, symbol, least((CASE WHEN contains(lower(title),
    lower(symbol)) THEN 0.5 ELSE 0 END) + (CASE WHEN contains(lower(summary), lower(symbol)) THEN 0.3 ELSE 0 END) +
    (CASE WHEN length(symbol) <= 4 THEN 0.2 ELSE 0 END), 1) AS relevance FROM (SELECT *, CASE id % 3 WHEN 0 THEN 'AAPL'
    WHEN 1 THEN 'MOONS' ELSE 'TSLA' END AS symbol FROM articles)""")
def _relevance(m):
    a = m.articles().withColumn("symbol", F.when(col("id") % 3 == 0, "AAPL").when(
        col("id") % 3 == 1, "MOONS").otherwise("TSLA"))
    return nw.news_relevance(a)


@query("news_weighted_sentiment", "symbol weighted:d", f"""SELECT symbol, sum(score * w) / sum(w) AS weighted FROM (
    SELECT CASE id % 2 WHEN 0 THEN 'AAPL' ELSE 'TSLA' END AS symbol, score, {_tier} *
    exp(-epoch({AT} - ts) / 3600 / 12) * confidence * 0.7 AS w FROM articles) GROUP BY 1""")
def _news_weighted(m):
    a = m.articles().withColumns({"symbol": F.when(col("id") % 2 == 0, "AAPL").otherwise("TSLA"),
                                  "relevance": F.lit(0.7)})
    return nw.news_weighted_sentiment(a, ["symbol"], AS_OF)


def _spike_sql(src, key, trunc, min_rows):
    return f"""SELECT {key}, CASE WHEN b >= 3 AND t >= {min_rows} THEN rec / greatest(coalesce(base, 0), 1) ELSE 0 END AS
    intensity, b >= 3 AND t >= {min_rows} AND rec / greatest(coalesce(base, 0), 1) > 2 AS has_spike FROM (SELECT {key},
    avg(n) FILTER (r <= 2) AS rec, avg(n) FILTER (r > 2) AS base, count(*) AS b, sum(n) AS t FROM (SELECT *, row_number()
    OVER (PARTITION BY {key} ORDER BY bucket DESC) AS r FROM (SELECT {key}, date_trunc('{trunc}', ts) AS bucket, count(*)
    AS n FROM {src} GROUP BY 1, 2)) GROUP BY 1)"""


@query("news_spike", "source intensity:d has_spike:b", _spike_sql("articles", "source", "hour", 0))
def _spike(m):
    return nw.activity_spike(m.articles(), ["source"])


@query("news_velocity_span", "source velocity:d",
       "SELECT source, count(*) / (epoch(max(ts) - min(ts)) / 3600) AS velocity FROM articles GROUP BY 1")
def _span(m):
    return nw.velocity_span(m.articles(), ["source"])


# ------------------------------------------------------------------ political trades

NAMES = list(wd.POLITICIANS) + ["someone else", "jane doe"]


def filings(m):
    """Filings written from the orders: seven date spellings, relative dates, ranges and suffixed amounts."""
    o = m.raw("orders")
    k, d, v = col("o_orderkey"), col("o_orderdate"), F.floor(col("o_totalprice")).cast("long")
    written = F.array(*[F.date_format(d, f) for f in nw.DATE_FORMATS],
                      F.concat(((k % 28) + 1).cast("string"), F.lit(" days ago")))
    commas = F.format_number(v, 0)
    amount = F.when(k % 3 == 0, F.concat(F.lit("$"), commas, F.lit(" - $"), F.format_number(v * 2, 0))).when(
        k % 3 == 1, F.concat(F.lit("$"), (v / 1000).cast("decimal(20,1)").cast("string"), F.lit("K"))).otherwise(
        F.concat(F.lit("$"), commas))
    return o.select(
        k.alias("id"), F.initcap(F.get(F.array(*[F.lit(n) for n in NAMES]), (col("o_custkey") % 10).cast("int")))
        .alias("reporter"), F.when(k % 5 < 3, "Purchase").otherwise("Sale (Full)").alias("txn_type"),
        amount.alias("amounts"), F.get(written, (k % 8).cast("int")).alias("transaction_date"),
        F.when(k % 4 == 0, F.lit("")).otherwise(F.get(F.array(*[F.lit(s) for s in ("aapl", "msft", "jpm", "xom", "nok")]),
                                                      (k % 5).cast("int"))).alias("symbol"),
        F.when(k % 8 == 0, "Some Holding Corp (LLYVK)").otherwise("none").alias("notes"), (k % 7 == 0).alias("is_insider"))


_party = "CASE " + " ".join(f"WHEN c % 10 = {i} THEN '{v[0]}'" for i, v in enumerate(wd.POLITICIANS.values())) + \
    " ELSE 'Unknown' END"
_power = "CASE " + " ".join(f"WHEN c % 10 = {i} THEN {v[1]}" for i, v in enumerate(wd.POLITICIANS.values())) + \
    " ELSE 1 END"
add_base("filed", f"""SELECT k AS id, c, CASE WHEN k % 8 = 7 THEN DATE '2001-09-01' - CAST(k % 28 + 1 AS INT)
      ELSE CAST(o_orderdate AS DATE) END AS trade_date,
    CASE k % 3 WHEN 0 THEN v * 1.5 WHEN 1 THEN CAST(v / 1000 AS DECIMAL(20,1))::DOUBLE * 1000 ELSE v END AS value,
    CASE WHEN k % 4 > 0 THEN (['AAPL', 'MSFT', 'JPM', 'XOM', 'NOK'])[k % 5 + 1] WHEN k % 8 = 0 THEN 'LLYVK'
      ELSE 'UNKNOWN' END AS symbol, {_party} AS party, {_power} AS influence,
    CASE WHEN k % 5 < 3 THEN 'buy' ELSE 'sell' END AS trade_type, k % 7 = 0 AS is_insider
    FROM (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders)""")


def trades(m):
    return nw.normalize_trades(filings(m), "2001-09-01")


@query("political_normalize_trades", "id:i trade_date value:d symbol party influence:i trade_type",
       "SELECT * FROM filed")
def _normalize(m):
    return trades(m)


@query("political_sentiment", "symbol congress_sentiment:d insider_sentiment:d overall_sentiment:d interest:d "
       "insider_confidence:d", """SELECT symbol, avg(CASE trade_type WHEN 'buy' THEN 1 ELSE -1 END) FILTER (NOT is_insider)
    AS congress_sentiment, avg(CASE trade_type WHEN 'buy' THEN 1 ELSE -1 END) FILTER (is_insider) AS insider_sentiment,
    avg(CASE trade_type WHEN 'buy' THEN 1 ELSE -1 END) AS overall_sentiment, least(count(*) / 10, 1) AS interest,
    least(avg(value) FILTER (is_insider) / 1e6, 1) AS insider_confidence FROM filed GROUP BY 1""")
def _political(m):
    return nw.political_sentiment(trades(m), ["symbol"])


@query("political_top_influence", "reporter influence:i total_value:d2 trades:i combined:d", f"""SELECT *,
    influence * ln(1 + total_value / 1e6) AS combined FROM (SELECT CASE c % 10 {' '.join(
        f"WHEN {i} THEN '{n.title() if '-' not in n else 'Alexandria Ocasio-cortez'}'" for i, n in enumerate(NAMES))}
    END AS reporter, max(influence) AS influence, sum(value) AS total_value, count(*) AS trades FROM filed GROUP BY 1)
    ORDER BY combined DESC, reporter LIMIT 5""")
def _influence(m):
    return nw.influence_metrics(trades(m))[1]


@query("political_influence_summary", "high_influence:i avg_influence:d",
       "SELECT count(*) FILTER (influence >= 4) AS high_influence, avg(influence) AS avg_influence FROM filed")
def _influence_sum(m):
    return nw.influence_metrics(trades(m))[0]


@query("political_party_divergence", "symbol Republican:d Democrat:d bipartisan:d divergence:d agreement:d", """
    SELECT symbol, r AS "Republican", d AS "Democrat", 2 / 3 AS bipartisan, abs(r - d) AS divergence, 1 - abs(r - d) AS
    agreement FROM (SELECT symbol, avg(s) FILTER (party = 'Republican') AS r, avg(s) FILTER (party = 'Democrat') AS d
    FROM (SELECT *, CASE trade_type WHEN 'buy' THEN 1 ELSE -1 END AS s FROM filed) GROUP BY 1)""")
def _party_div(m):
    return nw.party_divergence(trades(m), ["symbol"])


add_base("filed_ts", "SELECT *, CAST(trade_date AS TIMESTAMP) AS ts FROM filed")


@query("political_activity_spike", "symbol intensity:d has_spike:b", _spike_sql("filed_ts", "symbol", "day", 5))
def _daily_spike(m):
    return nw.activity_spike(trades(m).withColumn("ts", col("trade_date").cast("timestamp_ntz")), ["symbol"], "day", 5)


@query("political_velocity_per_day", "symbol velocity:d",
       "SELECT symbol, count(*) / (max(trade_date) - min(trade_date) + 1) AS velocity FROM filed GROUP BY 1")
def _per_day(m):
    return nw.velocity_span(trades(m).withColumn("ts", col("trade_date").cast("timestamp_ntz")), ["symbol"], "day")


@query("political_sector_exposure", "symbol trades:i sector relevance:d exposure:d", """SELECT symbol, count(*) AS trades,
    CASE symbol WHEN 'AAPL' THEN 'technology' WHEN 'MSFT' THEN 'technology' WHEN 'JPM' THEN 'finance' WHEN 'XOM' THEN
    'energy' ELSE 'unknown' END AS sector, least(count(*) / 5, 1) AS relevance, least(count(*) / 5, 1) * (CASE WHEN symbol
    IN ('AAPL', 'MSFT', 'JPM', 'XOM') THEN 4 ELSE 0 END) / 4 AS exposure FROM filed GROUP BY 1""")
def _sector(m):
    return nw.sector_exposure(trades(m))
