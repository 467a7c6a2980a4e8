"""Whole batch jobs: load faults, build the procedure corpus, render the dashboard."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators import chunks as ch
from ..operators import faults as fl
from ..operators import merge, metrics, search
from ..sources.files import fault_defaults, read_faults_csv


def _store(df: DataFrame, path: str) -> DataFrame:
    """Write a table and read it back, so that later steps start from the file."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def load_faults(spark: SparkSession, csv_path: str, root: str, as_of, seed: int = 0) -> dict[str, DataFrame]:
    """CSV files to the fault table and its derived tables below root.

    The CSV is parsed twice (good and bad rows); everything else starts from the stored table.
    """
    good, bad = read_faults_csv(spark, csv_path)
    faults = _store(fault_defaults(good, as_of), f"{root}/network_faults")
    enhanced = fl.enhance(faults, as_of)
    tables = {
        "Network Faults": faults,
        "Training Data": _store(fl.training_features(faults), f"{root}/training"),
        "Technician Metrics": _store(
            metrics.technician_metrics(enhanced, as_of), f"{root}/technician_metrics"
        ),
        "Equipment Reliability": _store(
            metrics.equipment_reliability(enhanced, as_of, seed), f"{root}/equipment_reliability"
        ),
    }
    return {
        **tables,
        "rejected": _store(bad, f"{root}/rejected"),
        "summary": metrics.load_summary(tables),
        "quality": metrics.fault_quality_summary(enhanced),
    }


def build_corpus(
    spark: SparkSession,
    documents: DataFrame,
    metadata: DataFrame,
    files: DataFrame,
    root: str,
    known_metadata: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Documents to files, metadata, chunks and the search index below root, with the reports.

    search.open_index(spark, root + "/index") gives the index to the searches.

    Metadata that is already known is kept as it is; only missing rows are added.
    """
    if known_metadata is not None:
        metadata = merge.insert_missing(known_metadata, metadata, ["document_id"])
    files = _store(files, f"{root}/files")
    metadata = _store(metadata, f"{root}/metadata")
    chunks = _store(ch.chunk_table(documents), f"{root}/chunks")
    index = search.store_index(search.index_documents(documents, metadata), f"{root}/index")
    searchable = ch.searchable_documents(documents, metadata, files)
    return {
        "files": files, "metadata": metadata, "chunks": chunks, "index": index.chunks,
        "searchable": searchable,
        "summary": metrics.load_summary({
            "PDF Files": files, "Document Metadata": metadata, "Document Chunks (200 chars)": chunks,
        }),
        "chunk_stats": metrics.chunk_stats(chunks),
        "searchable_summary": metrics.searchable_summary(searchable),
        "preview": ch.chunk_preview(chunks),
    }


@dataclass
class Dashboard:
    """One render: a cached slice and the small results drawn from it."""

    slice: DataFrame
    results: dict[str, DataFrame] = field(default_factory=dict)

    def close(self) -> None:
        self.slice.unpersist()


def dashboard(faults: DataFrame, as_of, sla: str = "category", **filters) -> Dashboard:
    """Everything the manager page shows, from one scan of the faults.

    Date and equality filters reach the scan. The slice is cached for the render only; close() it.
    """
    frame = fl.with_predictions(fl.enhance(faults, as_of), as_of, sla)
    shown = fl.dashboard_slice(frame, **filters).persist()
    impact = metrics.location_impact(shown)
    return Dashboard(shown, {
        "kpis": metrics.kpis(shown),
        "critical_alerts": fl.critical_alerts(shown),
        "category_impact": metrics.category_impact(shown),
        "priority_timeline": fl.priority_timeline(shown),
        "location_impact": impact,
        "location_rollup": metrics.location_rollup(impact),
        "triage": fl.triage_display(shown),
        "locations": metrics.facet_values(frame, "location"),
        "categories": metrics.facet_values(frame, "fault_category"),
    })
