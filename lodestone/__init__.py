"""Artifact documents and training data on Spark."""

from lodestone import catalog, freshness, manifest, run_results
from lodestone.functions.detect import LATEST, detect
from lodestone.sources.artifacts import read_artifacts

parse_manifest, parse_catalog, parse_run_results, parse_sources = manifest.parse, catalog.parse, run_results.parse, freshness.parse

__all__ = ["LATEST", "catalog", "detect", "freshness", "manifest", "parse_catalog", "parse_manifest", "parse_run_results", "parse_sources", "read_artifacts", "run_results"]
