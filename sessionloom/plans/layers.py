"""The shared middle layer: raw records once, everything else from small tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.operators import git as git_ops
from sessionloom.operators import ledger, profile, sessions, signals, timeline, usage
from sessionloom.operators.scan import CHUNK_ROWS
from sessionloom.operators.scope import scope_directories
from sessionloom.session import materialize


@dataclass
class Inputs:
    """Where the records come from; any dialect may be absent."""

    repositories: DataFrame
    counter_records: DataFrame | None = None
    response_records: DataFrame | None = None
    blob_messages: DataFrame | None = None
    blob_workspaces: DataFrame | None = None
    commits: DataFrame | None = None
    file_changes: DataFrame | None = None
    params: DataFrame | None = None
    chunk_rows: int = CHUNK_ROWS


class Layers:
    """Lazily built tables over one set of inputs.

    Tables that several results read are stored: the counter records with their carried state (inside ``counter_rows``), the
    response ledger, cells, and everything from sessions on. Counter records are read once; response records once each for
    the scope of their logs, the ledger, child logs, user turns and messages without a model, which prune to few columns.
    """

    def __init__(self, inputs: Inputs):
        self.inputs = inputs

    @cached_property
    def counter_rows(self) -> DataFrame:
        """Counter records with their state and accepted usage; the pass over the records is stored."""
        return ledger.counter_usage(self.inputs.counter_records, self.inputs.chunk_rows)

    @cached_property
    def counter_cells(self) -> DataFrame:
        return materialize(ledger.counter_cells(self.counter_rows))

    @cached_property
    def response_logs(self) -> DataFrame:
        return materialize(ledger.response_scope(self.inputs.response_records))

    @cached_property
    def response_ledger(self) -> DataFrame:
        return materialize(ledger.response_ledger(self.inputs.response_records, self.response_logs))

    @cached_property
    def response_cells(self) -> DataFrame:
        return materialize(ledger.response_cells(self.inputs.response_records, self.response_ledger))

    @cached_property
    def names(self) -> DataFrame:
        """Every distinct name once through redaction."""
        found = []
        if self.inputs.counter_records is not None:
            found.append(sessions.counter_names(self.counter_cells))
        if self.inputs.response_records is not None:
            found.append(self.response_cells.select("name"))
        return materialize(sessions.clean_names(*found))

    @cached_property
    def files(self) -> sessions.SessionTables:
        """Sessions as found in files, before one file per session is chosen."""
        parts, i = [], self.inputs
        if i.counter_records is not None:
            parts.append(sessions.counter_sessions(self.counter_cells, self.names, i.repositories))
        if i.response_records is not None:
            turns = ledger.user_turns(i.response_records, self.response_logs)
            parts.append(sessions.response_sessions(self.response_cells, self.response_logs, turns, self.names, i.repositories))
        if i.blob_messages is not None:
            parts.append(sessions.blob_sessions(i.blob_messages, i.blob_workspaces, i.repositories))
        return sessions.union_parts(parts)

    @cached_property
    def file_models(self) -> DataFrame:
        return materialize(self.files.models)

    @cached_property
    def file_tools(self) -> DataFrame:
        return materialize(self.files.tools)

    @cached_property
    def all_sessions(self) -> DataFrame:
        dated = sessions.latest_copies(materialize(self.files.sessions).filter(F.col("started_at").isNotNull()))
        return materialize(sessions.with_names(dated, self.file_models, self.file_tools))

    @cached_property
    def undated(self) -> DataFrame:
        """Matched sessions that were excluded for lack of any time."""
        none = self.files.sessions.filter(F.col("started_at").isNull())
        return none.select("repo_id", "session_ref", "provider", "source_id")

    @cached_property
    def without_model(self) -> DataFrame:
        """Repositories with a log that holds an assistant message without a model."""
        logs = self.response_logs
        placed = logs.join(scope_directories(logs, self.inputs.repositories, "cwd"), "cwd").select("repo_id", "source_id")
        return placed.join(ledger.without_model(self.inputs.response_records, logs), "source_id", "left_semi").select("repo_id").distinct()

    @cached_property
    def all_models(self) -> DataFrame:
        return sessions.of_files(self.file_models, self.all_sessions)

    @cached_property
    def all_tools(self) -> DataFrame:
        return sessions.of_files(self.file_tools, self.all_sessions)

    @cached_property
    def repositories(self) -> DataFrame:
        if self.inputs.commits is None:
            return self.inputs.repositories
        return materialize(self.inputs.repositories.join(git_ops.head_times(self.inputs.commits), "repo_id", "left"))

    @cached_property
    def windows(self) -> DataFrame:
        return materialize(usage.time_windows(self.all_sessions, self.repositories, self.inputs.params))

    @cached_property
    def sessions(self) -> DataFrame:
        return materialize(usage.in_window(self.all_sessions, self.windows))

    @cached_property
    def models(self) -> DataFrame:
        return sessions.of_files(self.file_models, self.sessions)

    @cached_property
    def tools(self) -> DataFrame:
        return sessions.of_files(self.file_tools, self.sessions)

    @cached_property
    def model_usage(self) -> DataFrame:
        return materialize(usage.model_usage(self.models, self.sessions))

    @cached_property
    def tool_usage(self) -> DataFrame:
        return usage.tool_usage(self.tools)

    @cached_property
    def totals(self) -> DataFrame:
        return usage.usage_totals(self.sessions)

    @cached_property
    def costs(self) -> DataFrame:
        return usage.cost_rollup(self.model_usage)

    @cached_property
    def git(self) -> DataFrame:
        return materialize(git_ops.git_metrics(self.inputs.commits, self.inputs.file_changes, self.windows))

    @cached_property
    def evidence(self) -> DataFrame:
        return sessions.evidence(self.sessions)

    @cached_property
    def git_rows(self) -> DataFrame:
        return timeline.git_evidence(self.git, self.windows, self.inputs.repositories)

    @cached_property
    def milestones(self) -> DataFrame:
        return timeline.milestones(self.sessions, self.evidence, self.git_rows)

    @cached_property
    def timeline(self) -> DataFrame:
        return timeline.timeline(self.sessions, self.evidence, self.git_rows)

    @cached_property
    def catalog(self) -> DataFrame:
        return signals.source_catalog(self.sessions, self.evidence, self.git_rows, self.windows)

    @cached_property
    def signals(self) -> DataFrame:
        return signals.signals(self.sessions, self.tool_usage, self.totals, self.git, self.windows, self.catalog)

    @cached_property
    def profiles(self) -> DataFrame:
        return profile.profiles(self.sessions, self.tool_usage, self.model_usage, self.totals, self.git, self.windows)

    def release(self) -> None:
        for name in ("counter_cells", "response_logs", "response_ledger", "response_cells", "names", "file_models", "file_tools", "all_sessions", "repositories", "windows", "sessions", "model_usage", "git"):
            if name in self.__dict__:
                self.__dict__[name].unpersist()

