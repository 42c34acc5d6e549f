"""Rules checked on the awkward values they exist for."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from shelfstream.functions import privacy as P
from shelfstream.functions import scalars as S
from shelfstream.functions.tokens import TokenRules, describe, token, uniform
from shelfstream.operators import cleaning as C
from shelfstream.sources import adapters

CONSENT = [
    (None, False, False),
    ("", False, False),
    ("   ", False, False),
    ("service", False, False),
    ("analytics", True, False),
    ("personalisation", False, False),
    ("analytics,personalisation", True, True),
    ("service, analytics", True, False),
    (" analytics , personalisation ", True, True),
    ("analytics-lite", False, False),
    ("nonanalytics", False, False),
    ("ANALYTICS", False, False),
    (",,,", False, False),
    ("analytics,", True, False),
]


def test_consent_on_awkward_values(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CONSENT)], "id int, consent string")
    rows = df.select(
        "id", P.permits("analytics").alias("a"), P.permits("training").alias("t"), P.permits("serving").alias("s")
    ).collect()
    for r in rows:
        assert (r.a, r.t, r.s) == (*CONSENT[r.id][1:], True)


def test_unknown_consumer_is_refused():
    with pytest.raises(ValueError, match="unknown consumer"):
        P.permits("marketing", "consent")


def test_consent_must_exist(spark):
    with pytest.raises(C.ConsentMissing):
        C.require_consent(spark.range(1))
    with pytest.raises(C.ConsentMissing):
        C.require_consent(spark.range(1).withColumn("consent", F.lit(None).cast("string")))
    C.require_consent(spark.range(1).withColumn("consent", F.lit("service")))


@pytest.mark.parametrize("key", [b"k" * 16, b"x" * 64, b"long " * 20])
def test_pseudonym_is_hmac(spark, key):
    values = ["U000001", "", "ünï", "a" * 200]
    df = spark.createDataFrame([(v,) for v in values], "user_id string")
    got = {r.user_id: r.p for r in df.select("user_id", P.pseudonym("user_id", key).alias("p")).collect()}
    for v in values:
        assert got[v] == hmac.new(key, v.encode(), hashlib.sha256).hexdigest()[:32] == P.pseudonym_of(v, key)


def test_key_rules(monkeypatch):
    monkeypatch.delenv(P.KEY_VARIABLE, raising=False)
    with pytest.raises(ValueError, match="no pseudonym key"):
        P.pseudonym_key()
    with pytest.raises(ValueError, match="at least 16"):
        P.pseudonym_key("short")
    assert P.key_fingerprint(P.pseudonym_key("a" * 16)) != P.key_fingerprint(b"b" * 16)


def test_tokens(spark):
    rules = TokenRules.of(
        "sku",
        {"Apparel": "style_color", "electronics": {"level": "product", "plus_attributes": ["capacity", "color"]}},
    )
    rows = [
        ("s1", "c1", "p1", "APPAREL", {"color": "red"}, "c1"),
        ("s2", None, "p2", "apparel", {}, "s2"),
        ("s3", "c3", "p3", "electronics", {"capacity": "256GB"}, "p3|capacity=256GB"),
        ("s4", "c4", "p4", "electronics", {"color": "red", "capacity": "1TB"}, "p4|capacity=1TB|color=red"),
        ("s5", "c5", "p5", "electronics", None, "p5"),
        ("s6", "c6", "p6", None, {}, "s6"),
    ]
    df = spark.createDataFrame(
        rows, "sku string, style_color_id string, product_id string, category string, "
        "attributes map<string,string>, expected string"
    )
    assert df.filter(~token(rules).eqNullSafe(F.col("expected"))).count() == 0
    assert describe(rules) == {
        "_default": "sku", "apparel": "style_color", "electronics": "product + capacity,color"
    }
    assert describe(uniform("product")) == {"_default": "product"}
    with pytest.raises(ValueError, match="unknown granularity level"):
        TokenRules.of("brand")


def test_unknown_dataset(spark):
    with pytest.raises(ValueError, match="unknown dataset"):
        adapters.load_dataset(spark, "nope")


def test_rejects_carry_every_reason(spark):
    df = spark.createDataFrame(
        [
            ("1", "u", "s", "view", "k", 1.0, 1, None),
            ("2", "", "s", "view", "k", -1.0, -1, None),
            ("3", "u", "s", "return", "k", None, None, ""),
            ("4", "u", "s", "stare", "k", None, None, None),
        ],
        "event_id string, user_id string, session_id string, event_type string, sku string, price double, "
        "quantity int, order_id string",
    ).withColumn("event_ts", F.current_timestamp())
    valid, rejected = C.split_valid(df)
    assert [r.event_id for r in valid.collect()] == ["1"]
    reasons = {r.event_id: r.reasons for r in rejected.collect()}
    assert reasons == {
        "2": ["missing user_id", "negative quantity", "negative price"],
        "3": ["return without order_id"],
        "4": ["unknown event_type"],
    }
    with pytest.raises(C.InvalidMessage):
        C.split_valid(df, skip_invalid=False)
    extra, bad = C.split_valid(df.filter("event_id = '1'").withColumn("surprise", F.lit("x")))
    assert extra.count() == 0 and bad.first().reasons == ["unknown field surprise"]


def test_parse_unix(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:10Z",), ("soon",), (None,)], "t string")
    assert [r[0] for r in df.select(S.parse_unix(F.col("t"))).collect()] == [1704067210, 0, 0]


def test_stable_functions_at_the_extremes(spark):
    row = spark.range(1).select(
        S.sigmoid(F.lit(800.0)), S.sigmoid(F.lit(-800.0)), S.softplus(F.lit(800.0)), S.logit(F.lit(0.0))
    ).first()
    assert row[0] == 1.0 and 0 <= row[1] < 1e-300 and row[2] == 800.0 and -17 < row[3] < -16


def test_consent_names_whole_entries(spark):
    texts = ["analytics", " analytics ", "service , analytics", "service,\tanalytics\t,x", "\tanalytics", "analytics\n",
             "analytics2", "xanalytics,service", "analytics;service", "", None, "service,analytics ", ",analytics,", "ANALYTICS"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, consent string")
    # One search for a purpose: the text was split and its parts compared one by one.
    plan = df.filter(P.permits("analytics"))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "split" not in plan and "exists" not in plan
    found = {r["id"] for r in df.filter(P.permits("analytics")).collect()}
    assert {texts[i] for i in found} == {"analytics", " analytics ", "service , analytics", "service,\tanalytics\t,x", "service,analytics ", ",analytics,"}


def test_fashion_sales_meet_their_articles_as_they_were_read(spark):
    # Ids, sessions and orders were derived before: four times the sale went through the join's shuffle.
    sales = spark.createDataFrame(
        [("2024-01-02", "c1", "a1", 9.5, "1"), ("2024-01-02", "c1", "a1", 9.5, "1"), ("2024-01-03", "c2", "a2", None, "2"),
         ("2024-01-03", "c2", "gone", 1.0, "2"), ("2024-01-03", "c3", None, 1.0, "2")],
        "t_dat string, customer_id string, article_id string, price double, sales_channel_id string",
    )
    articles = spark.createDataFrame(
        [("a1", "p1", "Top", "Red", ""), ("a2", "p2", "Top", None, "")],
        "article_id string, product_code string, product_type_name string, colour_group_name string, department_name string",
    )
    wide, items = adapters.fashion(sales, articles)
    more = {"product_id": F.col("product_id"), "color": F.col("attributes")["color"]}
    narrow, _ = adapters.fashion(sales, articles, more)
    late = wide.join(items.select("sku", *[c.alias(n) for n, c in more.items()]), "sku").select(narrow.columns)
    assert sorted(map(str, narrow.collect())) == sorted(map(str, late.collect())) and narrow.count() == 3
    plan = narrow._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan[plan.index("Join"):]
