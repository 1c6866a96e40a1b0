"""Jobs from files to a file, read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskflow.checks.base import KEY, ORACLES, digest, draw, register, slots, table
from maskflow.checks.mask_checks import LAST, LAST_SQL
from maskflow.checks.tables import people
from maskflow.plans.jobs import generate_file, mask_file
from maskflow.session import scratch_path
from maskflow.sources.files import read_csv
from maskflow.sources.sinks import write_config, write_table

COLUMNS = ["id", "nachname", "adresse", "strasse", "ahv"]


@register(
    "job_mask_file",
    f"""
WITH l AS ({LAST_SQL}), a AS ({ORACLES['mask_ahv_nr']}), c AS ({ORACLES['mask_shuffle_codes']})
SELECT cast(l.id AS varchar) AS id, l.nachname, c.adresse, a.ahv FROM l JOIN a USING (id) JOIN c USING (id)
""",
)
def job_mask_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People from CSV to CSV by a configuration file; one column is shuffled, one deleted."""
    root = scratch_path(spark, "job")
    write_table(people(spark, sf_dir).select(*COLUMNS), f"{root}/people.csv", {"separator": ";", "encoding": "ISO-8859-1"})
    text = {"data_type": "string"}
    columns = LAST | {"adresse": text | {"function": "shuffle_codes"}, "strasse": text | {"function": "delete"}, "ahv": text | {"function": "ahv_nr"}}
    write_config(spark, {"filename": "masked.csv", "separator": "\t", "columns": columns}, f"{root}/people.json")
    report = mask_file(spark, f"{root}/people.csv", f"{root}/people.json", f"{root}/out", key=KEY)
    return read_csv(spark, f"{report.path}/*.csv")


NAMES = "SELECT p_name AS nachname, cast(count(*) AS integer) AS anzahl FROM part GROUP BY p_name"


@register(
    "job_generate_file",
    f"""
WITH s AS ({slots(NAMES, ['nachname'], 'anzahl')}), r AS (SELECT unnest(range((SELECT count(*) FROM customer))) AS id)
SELECT 10 + 3 * id AS number, s.nachname AS family_name FROM r JOIN s ON {draw(digest('family_name', 'id'))} % s.total >= s.lo AND {draw(digest('family_name', 'id'))} % s.total < s.hi
""",
)
def job_generate_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each customer, with names from a lookup folder, to parquet by a configuration file."""
    root = scratch_path(spark, "job")
    names = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("nachname")).agg(F.count("*").cast("int").alias("anzahl"))
    names.write.parquet(f"{root}/lookups/last_names.parquet")
    columns = {"number": {"function": "incremental_int", "min": 10, "step": 3}, "family_name": {"function": "last_name", "source": "ogd-bs"}}
    config = {"filename": "made.parquet", "rows": table(spark, sf_dir, "customer").count(), "columns": columns}
    write_config(spark, config, f"{root}/made.json")
    report = generate_file(spark, f"{root}/made.json", f"{root}/out", f"{root}/lookups", KEY)
    return spark.read.parquet(report.path)
