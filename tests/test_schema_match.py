"""Column-name matching: known answers, and a plain version of the rule on random names."""

import random
import re
from datetime import datetime
from difflib import SequenceMatcher

import pytest

from recordloom.operators import schema_match
from recordloom.operators.schema_match import ALIASES, CANONICAL, SYNONYMS

KNOWN = [
    ("customerID", "customer_id", 1.0, "Dictionary Match"),
    ("Client Name", "customer_name", 1.0, "Dictionary Match"),
    ("Mobile", "phone_number", 1.0, "Dictionary Match"),
    ("revenue", "revenue", 1.0, "Dictionary Match"),
    ("CustNo", "customer_name", 0.99, "AI Suggested"),
    ("Cust-Name", "customer_name", 0.99, "AI Suggested"),
    ("Phone No", "phone_number", 0.99, "AI Suggested"),
    ("DOB", "date_of_birth", 0.99, "AI Suggested"),
    ("addr", "address", 0.99, "AI Suggested"),
    ("email", "email_address", 0.705556, "AI Suggested"),
    ("Mail", "email_address", 0.705556, "AI Suggested"),
    ("name", "customer_name", 0.620588, "AI Suggested"),
    ("tenure", "revenue", 0.615385, "AI Suggested"),
    ("user_id", "customer_id", 0.927778, "AI Suggested"),
    ("c_name", "customer_name", 0.781579, "AI Suggested"),
    ("n_name", "customer_name", 0.676316, "AI Suggested"),
    ("id", "id", 0.257692, "Unmapped"),
    ("City", "city", 0.1, "Unmapped"),
    ("MonthlyCharges", "monthly_charges", 0.3, "Unmapped"),
    ("TotalCharges", "total_charges", 0.338462, "Unmapped"),
    ("c_custkey", "c_custkey", 0.3, "Unmapped"),
    ("c_acctbal", "c_acctbal", 0.1, "Unmapped"),
    ("c_mktsegment", "c_mktsegment", 0.2, "Unmapped"),
    ("o_totalprice", "o_totalprice", 0.28, "Unmapped"),
    ("account_balance", "account_balance", 0.157143, "Unmapped"),
    ("gender", "gender", 0.261538, "Unmapped"),
]


def names_df(spark, names):
    return spark.createDataFrame([(n,) for n in names], "original_column string").coalesce(1)


def test_known_answers(spark):
    got = schema_match.match_names(names_df(spark, [k[0] for k in KNOWN])).collect()
    assert [(r[0], r[1], round(r[2], 6), r[3]) for r in got] == KNOWN


def plain_match(name):
    words = re.sub(r"[\s\W]+", "_", re.sub(r"(?<=[a-z])(?=[A-Z])", "_", name)).lower().strip("_").split("_")
    key = re.sub(r"[\s_]+", "", name.lower())
    snake = "_".join(words)
    if key in ALIASES:
        return ALIASES[key], 1.0, "Dictionary Match"
    if snake in ALIASES.values() or key in ALIASES.values():
        return snake, 1.0, "Dictionary Match"
    words = [SYNONYMS.get(w, w) for w in words]
    best, target = 0.0, None
    for canonical in CANONICAL:
        parts = canonical.split("_")
        score = SequenceMatcher(None, "_".join(words), canonical).ratio()
        common = set(words) & set(parts)
        if common:
            score += 0.3 * (len(common) / max(len(words), len(parts)))
        if score > best:
            best, target = score, canonical
    best = min(0.99, best)
    return (target, best, "AI Suggested") if best >= 0.55 else (snake, max(0.1, best - 0.2), "Unmapped")


def test_random_names(spark):
    rng = random.Random(5)
    pieces = [*SYNONYMS, *ALIASES, *"customer name phone number address email date birth of id x Q 7 é ß".split()]
    names = {
        rng.choice(["", " ", "_"]) + rng.choice(["_", " ", "-", "", "__", ". "]).join(
            rng.choice([str.lower, str.title, str.upper])(rng.choice(pieces)) for _ in range(rng.randrange(1, 4))
        )
        for _ in range(600)
    }
    names |= {"", "_", "--", "".join(rng.choice("abcrevnu_") for _ in range(300))}
    got = schema_match.match_names(names_df(spark, sorted(names))).collect()
    assert [(r[1], r[2], r[3]) for r in got] == [plain_match(n) for n in sorted(names)]


def test_report_lists_each_name_once(spark):
    tables = {
        "a": spark.createDataFrame([(1, 2)], "id int, email int"),
        "b": spark.createDataFrame([(1, 2)], "id int, DOB int"),
    }
    report = schema_match.schema_report(schema_match.column_names(spark, tables))
    rows = {r["original_column"]: (r["suggested"], r["match_type"], r["badge"]) for r in report.collect()}
    assert rows == {
        "id": ("ignore", "Unmapped", "danger"),
        "email": ("email_address", "AI Suggested", "warning"),
        "DOB": ("date_of_birth", "AI Suggested", "success"),
    }


def test_automatic_renaming_coalesces_equal_targets(spark):
    table = spark.createDataFrame([(None, "b", 1), ("a", "c", 2)], "mobile string, phone string, `x.y` int")
    renamed, report = schema_match.rename_auto(spark, {"t": table})
    assert renamed["t"].columns == ["phone_number", "x.y"]
    assert [tuple(r) for r in renamed["t"].collect()] == [("b", 1), ("a", 2)]
    assert [(r[1], r[2], r[3]) for r in report.collect()] == [("mobile", "phone_number", 1.0), ("phone", "phone_number", 1.0)]


def test_manual_renaming(spark):
    table = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    renamed, report = schema_match.rename_manual(spark, {"t": table}, {"a": "revenue", "b": "ignore", "c": "", "z": "q"})
    assert renamed["t"].columns == ["revenue", "b", "c"]
    assert [tuple(r) for r in report.collect()] == [(1, "a", "revenue", 100.0, "Manual")]


TEMPLATES = "template_id string, user_id string, template_name string, mapping map<string,string>, created_at timestamp"


def template(number, user, keys):
    return (f"t{number}", user, f"T{number}", {k: "revenue" for k in keys}, datetime(2024, 1, number))


@pytest.fixture
def templates(spark):
    rows = [template(1, "u", "ab"), template(2, "u", "abc"), template(3, "u", "abcz"), template(4, "v", "a")]
    return spark.createDataFrame(rows, TEMPLATES)


def test_best_template(templates):
    rows = schema_match.best_template(templates, list("abcde")).collect()
    assert [(r["user_id"], r["template_id"], r["match_score"]) for r in rows] == [("u", "t2", 60)]


def test_template_score_is_cut_not_rounded(templates):
    # 29 of 100 columns: 0.29 * 100 is just below 29 in binary.
    keys = [f"k{i}" for i in range(29)]
    wide = templates.sparkSession.createDataFrame([template(1, "u", keys)], TEMPLATES)
    columns = keys + [f"o{i}" for i in range(71)]
    assert schema_match.template_scores(wide, columns).first()["match_score"] == int(29 / 100 * 100)


def test_template_listing(templates):
    rows = schema_match.template_list(templates, "u").collect()
    assert [(r["template_id"], r["mappings_count"]) for r in rows] == [("t3", 4), ("t2", 3), ("t1", 2)]
