"""The sidebar's filters over entries, all of them joined by 'and'."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.functions.arrays import has_all

#: Attachment types that count as files.
FILE_TYPES = ["file", "raw", "pdf"]


@dataclass
class EntryFilter:
    """What is selected; the defaults select everything."""

    project: str | int = "all"
    experiment: str = "all"
    project_tags: list[str] = field(default_factory=list)
    experiment_tags: list[str] = field(default_factory=list)
    has_image: bool = False
    has_file: bool = False
    day: date | None = None
    days: tuple[date, date] | None = None


def in_project(project: str | int) -> Column:
    return F.lit(True) if project == "all" else F.col("project_id") == project


def on_day(ts: Column, day: date) -> Column:
    """Whether a time without zone falls on a date, as a range that reaches the scan."""
    begin = F.to_timestamp_ntz(F.lit(f"{day.isoformat()} 00:00:00"))
    return (ts >= begin) & (ts < begin + F.expr("INTERVAL 1 DAY"))


def in_experiment(experiment: str) -> Column:
    """'all', 'none' (null or empty), or one id."""
    if experiment == "all":
        return F.lit(True)
    if experiment == "none":
        return F.coalesce("experiment_id", F.lit("")) == ""
    return F.col("experiment_id") == experiment


def filtered(entries: DataFrame, attachments: DataFrame, by: EntryFilter, matched: DataFrame | None = None) -> DataFrame:
    """The entries that pass; matched (id) are those that a search found, None without one. `days` is an extension."""
    out = entries.where(in_project(by.project) & in_experiment(by.experiment))
    out = out.where(has_all(F.col("project_tags"), by.project_tags) & has_all(F.col("experiment_tags"), by.experiment_tags))
    if by.day is not None:
        out = out.where(F.col("date_bucket") == F.lit(by.day))
    if by.days is not None:
        out = out.where(F.col("date_bucket").between(*map(F.lit, by.days)))
    for wanted, types in ((by.has_image, ["image"]), (by.has_file, FILE_TYPES)):
        if wanted:
            out = out.join(attachments.where(F.col("type").isin(types)).select(F.col("entry_id").alias("id")), "id", "left_semi")
    if matched is not None:
        out = out.join(matched.select("id"), "id", "left_semi")
    return out


def experiments_of(experiments: DataFrame, project: str) -> DataFrame:
    """Experiments of one project; 'all' or '' means every project's."""
    return experiments if project in ("all", "") else experiments.where(F.col("project_id") == project)


def valid_experiments(experiments: DataFrame, selected: DataFrame, project: str) -> DataFrame:
    """selected (experiment) with shown: the experiment, or 'all' if it is gone or in another project."""
    there = experiments_of(experiments, project).select(F.col("id").alias("experiment"), F.lit(True).alias("_there")).distinct()
    kept = F.col("_there") | F.col("experiment").isin("all", "none")
    return selected.join(there, "experiment", "left").withColumn("shown", F.when(kept, F.col("experiment")).otherwise("all")).drop("_there")


def valid_experiment(experiments: DataFrame, project: str, experiment: str) -> str:
    """The selected experiment, or 'all' if it is gone or in another project."""
    if experiment in ("all", "none"):
        return experiment
    return experiment if experiments_of(experiments, project).where(F.col("id") == experiment).take(1) else "all"


def selected(filtered_entries: DataFrame, chosen: str) -> DataFrame:
    """(id): the chosen entry if it passed, else the first that did, else null."""
    return filtered_entries.agg(F.coalesce(F.max(F.when(F.col("id") == chosen, F.col("id"))), F.min_by("id", "seq")).alias("id"))


def experiment_in_project(entries: DataFrame, experiments: DataFrame) -> DataFrame:
    """entries whose experiment is cleared where it is not one of the entry's project."""
    known = experiments.select(F.col("id").alias("experiment_id"), "project_id", F.lit(True).alias("_known"))
    return entries.join(known, ["experiment_id", "project_id"], "left").withColumn("experiment_id", F.when(F.col("_known"), F.col("experiment_id"))).drop("_known").select(*entries.columns)
