"""All oracle statements by query name."""

from __future__ import annotations

from oracles import insights, logs, story, texts, usage

SQL = {**usage.SQL, **insights.SQL, **texts.SQL, **logs.SQL, **story.SQL}
