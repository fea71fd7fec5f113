"""Spark DataFrame operators for measurements that live at positions."""

from sitewise.session import build_session, checkpointed

__all__ = ["build_session", "checkpointed"]
