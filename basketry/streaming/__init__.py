from basketry.streaming.sessions import run_sessions, session_stats  # noqa: F401
