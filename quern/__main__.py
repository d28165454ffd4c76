"""Commands: prepare, score, explore, predict. Tables go to Parquet, results to CSV."""

from __future__ import annotations

import argparse

from quern import pipeline
from quern.operators import quality
from quern.session import local_session
from quern.sources.connectors import read_csv
from quern.sources.sinks import Paths, canonical_hash, write_manifest, write_result, write_table
from quern.streaming import scoring

KEYS = ["entity_id", "year"]
SPEC = {"budget": scoring.BUDGET, "labels": ["trust", "threat"], "scorer": "stand-in"}
CROSSWALK = "source_name string, entity_id string, country_name string, valid_from int, valid_to int, mapping_rationale string, exclusion_status string"


def _config(spark, folder: str) -> dict:
    read = lambda name, schema: read_csv(spark, f"{folder}/{name}.csv", schema)
    return {
        "corrections": read("corrections", "iso string, session int, year int, corrected string"),
        "entity_rules": read("entity_rules", "source_label string, valid_from int, valid_to int, entity_id string, entity_type string"),
        "countries": read("countries", "entity_id string, country_name string"),
        "spending_crosswalk": read("spending_crosswalk", CROSSWALK),
        "conflict_crosswalk": read("conflict_crosswalk", CROSSWALK),
    }


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quern", description=__doc__)
    parser.add_argument("command", choices=("prepare", "score", "explore", "predict"))
    parser.add_argument("--root", default=".", help="folder of the raw files")
    parser.add_argument("--config", default="config", help="folder of the reviewed tables")
    parser.add_argument("--output", default="outputs")
    parser.add_argument("--sessions", type=int, default=80, help="session folders there must be; 0: any")
    parser.add_argument("--limit", type=int, help="texts to score in this run")
    parser.add_argument("--replicates", type=int, default=2000)
    a = parser.parse_args(argv)
    spark, out = local_session(), a.output

    if a.command == "prepare":
        paths = Paths.from_env(a.root)
        made = pipeline.prepare(spark, paths, **_config(spark, a.config), sessions=a.sessions or None)
        for name, df in (("panel", made.panel), ("conflicts", made.conflicts)):
            write_table(df, f"{out}/{name}")
        made.write_audits(f"{out}/audits")
        panel = spark.read.parquet(f"{out}/panel")
        fingerprint = quality.corpus_fingerprint(panel, KEYS, "speech_clean").head()[0]
        write_manifest(f"{out}/manifest.json", sources=[paths.metadata_path, paths.conflicts_path, paths.spending_path], rows={"panel": panel.count()}, fingerprint=fingerprint, settings=SPEC)
        return
    panel = spark.read.parquet(f"{out}/panel")
    if a.command == "score":
        with scoring.single_writer(f"{out}/scores.lock"):
            spec = canonical_hash(SPEC)
            todo = scoring.to_score(panel, scoring.open_cache(spark, f"{out}/scores", spec), KEYS, "speech_clean")
            if a.limit:
                todo = todo.orderBy("year", "entity_id").limit(a.limit)
            made = scoring.scored(todo, KEYS, "speech_clean", spec).withColumnsRenamed({"trust": "trust_score", "threat": "threat_score"})
            made.write.mode("append").parquet(f"{out}/scores")
        return
    scores = spark.read.parquet(f"{out}/scores").select(*KEYS, "trust_score", "threat_score")
    scored = panel.join(scores, KEYS, "left")
    tables = pipeline.explore(scored, replicates=a.replicates) if a.command == "explore" else pipeline.predict(scored, spark.read.parquet(f"{out}/conflicts"))
    for name, df in tables.items():
        write_result(df, f"{out}/{a.command}/{name}", 6)


if __name__ == "__main__":
    main()
