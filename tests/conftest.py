import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from headgrid.schema import TABLES  # noqa: E402
from headgrid.session import local_session  # noqa: E402

NOW = dt.datetime(2025, 1, 1, 12)


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "headgrid-tests")
    yield session
    session.stop()


def day(text):
    return None if text is None else dt.date.fromisoformat(text if len(text) == 10 else text + "-01")


@pytest.fixture(scope="session")
def entries(spark):
    """Build forecast rows from ``dict(subject, valid_from, valid_to, ...)``."""
    from decimal import Decimal

    def build(*rows):
        out = []
        for i, r in enumerate(rows):
            deleted = r.get("is_deleted", False)
            container = r.get("container")
            out.append(
                (
                    r.get("id", f"e{i}"), r.get("version", "v1"),
                    None if container else r.get("employee", "A"), container,
                    r.get("first_name", "Ada"), r.get("last_name", "L"), r.get("cc", "c1"), r.get("cls"), r.get("grp"), None,
                    Decimal(str(r.get("fte", 1))), day(r["valid_from"]), day(r.get("valid_to")), deleted,
                    NOW if deleted else None, "u" if deleted else None, "u", NOW,
                )
            )
        return spark.createDataFrame(out, TABLES["forecast_entries"])

    return build


@pytest.fixture(scope="session")
def changes(spark):
    """Build change requests from ``(seq, op, month, subject, fte)``."""
    from decimal import Decimal

    schema = (
        "version_id string, employee_id string, container_id string, seq long, op string, valid_from date, first_name string, "
        "last_name string, costcenter_id string, classification_id string, employee_group_id string, job_description string, "
        "fte decimal(6,4), changed_by string, changed_at timestamp"
    )

    def build(*rows, actor="u"):
        out = []
        for seq, op, month, subject, fte in rows:
            container = subject.startswith("P")
            out.append(
                ("v1", None if container else subject, subject if container else None, seq, op, day(month), "Ada", "L", "c1", None, None,
                 None, Decimal(str(fte)), actor, NOW + dt.timedelta(seconds=seq))
            )
        return spark.createDataFrame(out, schema)

    return build
