"""Status and display names of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Former states, and names that go before those of a country list.
HISTORICAL = ("CSK", "DDR", "YUG", "YMD", "SUN", "BYSSR", "UASSR")
#: Statuses by type of rule and code. A star stands for any code, a question mark for any other type, a
#: dash for entities without a rule.
STATUSES = {
    "observer_state PSE": "sensitivity_observer", "- PSE": "sensitivity_observer", "observer_state *": "excluded_observer_no_sipri", "- VAT": "excluded_observer_no_sipri",
    "non_state_aggregate *": "excluded_non_state", "- EU": "excluded_non_state", "? *": "excluded_historical", **{f"- {code}": "excluded_historical" for code in HISTORICAL},
}
LISTED, UNLISTED = "main_un_member", "unresolved_iso"
DISPLAY_NAMES = {
    "BOL": "Bolivia", "BRN": "Brunei", "COD": "Congo, Democratic Republic of the", "COG": "Congo, Republic of the", "CZE": "Czechia", "GBR": "United Kingdom", "IRN": "Iran", "KOR": "Korea, South",
    "LAO": "Laos", "MDA": "Moldova", "PRK": "Korea, North", "RUS": "Russia", "SYR": "Syria", "TZA": "Tanzania", "USA": "United States", "VEN": "Venezuela", "VNM": "Vietnam",
    "SUN": "Soviet Union", "BYSSR": "Byelorussian Soviet Socialist Republic", "UASSR": "Ukrainian Soviet Socialist Republic",
}


def entity_status(entity: Column, rule_type: Column, listed: Column) -> Column:
    """Status of an entity, looked up in STATUSES: the nearest key there is, else by the country list."""
    table = F.create_map(*[F.lit(x) for pair in STATUSES.items() for x in pair])
    kind = F.coalesce(rule_type, F.lit("-"))
    keys = [F.concat(kind, F.lit(" "), F.coalesce(entity, F.lit(""))), F.concat(kind, F.lit(" *")), F.when(rule_type.isNotNull(), "? *")]
    return F.coalesce(*[F.try_element_at(table, k) for k in keys], F.when(listed, LISTED).otherwise(UNLISTED))


def main_population(status: Column) -> Column:
    return status == LISTED


def display_name(df: DataFrame, entity: str, names: DataFrame, name: str = "country_name", overrides: dict[str, str] = DISPLAY_NAMES) -> DataFrame:
    """Adds ``display_name``: the override, else the listed name, else the code. ``names`` has entity_id and ``name``."""
    own = F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv])
    n = names.select(F.col("entity_id").alias("__id"), F.col(name).alias("__name")).dropDuplicates(["__id"])
    return df.join(n, df[entity] == n["__id"], "left").withColumn("display_name", F.coalesce(own[F.col(entity)], "__name", entity)).drop("__id", "__name")
