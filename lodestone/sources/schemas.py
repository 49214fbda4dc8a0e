"""The chunk tables: columns, partitions, keys, and how they are served."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.patterns import PROBLEMS

# number of partitions of a table keyed by source id
ID_BUCKETS = 64


@dataclass(frozen=True)
class Table:
    columns: str
    partitions: str
    # replaced by version, or by this source id
    id_column: str = ""

    @property
    def partition_names(self) -> list[str]:
        return [c.strip().split()[0] for c in self.partitions.split(",")]

    @property
    def column_names(self) -> list[str]:
        return [c.strip().split()[0] for c in self.columns.strip().split("\n")]


# Columns of the four chunk tables.
TABLES = {
    "code_chunks": Table(
        f"""chunk_id string,
        content string,
        ingested_at timestamp,
        file_path string,
        chunk_type string,
        qualified_name string,
        signature string,
        spark_apis array<string>,
        problem_indicators {PROBLEMS},
        start_line int,
        end_line int""", "spark_version string, language string"),
    "doc_chunks": Table(
        """chunk_id string,
        content string,
        ingested_at timestamp,
        doc_url string,
        doc_section string,
        heading_hierarchy array<string>,
        content_type string,
        related_configs array<string>""", "spark_version string"),
    "qa_chunks": Table(
        """chunk_id string,
        content string,
        ingested_at timestamp,
        question_id bigint,
        is_question boolean,
        score bigint,
        is_accepted boolean,
        tags array<string>,
        error_type string,
        spark_apis_mentioned array<string>,
        spark_versions_mentioned array<string>""", "bucket int", "question_id"),
    "issue_chunks": Table(
        """chunk_id string,
        content string,
        ingested_at timestamp,
        issue_number bigint,
        state string,
        is_comment boolean,
        parent_issue_number bigint,
        author string,
        labels array<string>,
        created_at string,
        closed_at string,
        spark_versions_mentioned array<string>,
        linked_prs array<bigint>""", "bucket int", "issue_number"),
    "chunk_vectors": Table(
        """table_name string,
        chunk_id string,
        vec array<float>""", "model_column string"),
}

# List columns served as JSON objects, and the key inside; no key, a plain list.
SERVED_LISTS = {
    "code_chunks": {"spark_apis": "apis", "problem_indicators": "patterns"},
    "doc_chunks": {"heading_hierarchy": None, "related_configs": "configs"},
    "qa_chunks": {"tags": "tags", "spark_apis_mentioned": "apis",
                  "spark_versions_mentioned": "versions"},
    "issue_chunks": {"labels": "labels", "spark_versions_mentioned": "versions",
                     "linked_prs": "prs"},
}

# Served columns, in order, with their length limits (0: none).
SERVED_COLUMNS = {
    "code_chunks": {"content": 65535, "spark_version": 0, "file_path": 0, "language": 0,
                    "chunk_type": 0, "qualified_name": 512, "signature": 1024,
                    "spark_apis": 0, "problem_indicators": 0},
    "doc_chunks": {"content": 65535, "spark_version": 0, "doc_url": 512, "doc_section": 256,
                   "heading_hierarchy": 0, "content_type": 0, "related_configs": 0},
    "qa_chunks": {"content": 65535, "question_id": 0, "is_question": 0, "score": 0,
                  "is_accepted": 0, "tags": 0, "error_type": 256, "spark_apis_mentioned": 0,
                  "spark_versions_mentioned": 0},
    "issue_chunks": {"content": 65535, "issue_number": 0, "state": 16, "is_comment": 0,
                     "parent_issue_number": 0, "author": 128, "labels": 0, "created_at": 32,
                     "closed_at": 32, "spark_versions_mentioned": 0, "linked_prs": 0},
}
