"""login/logout protocol of a session as set/reset windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import last_seen, running_max, running_sum, scan

# fixed values: default events, categories and allowed transitions
LOGIN = ["login"]
LOGOUT = ["logout"]
AUTH_CATEGORIES = ["AUTH"]
NEEDS_AUTH = ["READ", "UPDATE", "WRITE", "DELETE", "ADMIN"]
CATEGORY_OF_EVENT = {
    "login": "AUTH", "logout": "AUTH", "browse": "READ", "view": "READ", "read": "READ",
    "edit": "UPDATE", "save": "UPDATE", "update": "UPDATE", "delete": "UPDATE",
}
SESSION_FORM = r"^[A-Za-z0-9:_-]{8,}$"
ALLOWED = [
    ("login", "browse"), ("login", "logout"), ("browse", "browse"), ("browse", "edit"), ("browse", "logout"),
    ("edit", "save"), ("edit", "browse"), ("edit", "logout"), ("save", "logout"),
]


def protocol_violations(
    df: DataFrame,
    session: str = "session_id",
    user: str = "user_id",
    token: str = "uid",
    epoch: str = "epoch_s",
    index: str = "row_index",
    allowed: Sequence[tuple[str, str]] = ALLOWED,
) -> DataFrame:
    """Add the array ``violations`` and the state after the row.

    Whether a user is logged in before a row is the last login or logout marker
    on earlier rows; rows without session id share one context.
    """
    def text(c):
        return F.nullif(F.trim(F.col(c)), F.lit(""))

    name = F.lower(text("event"))
    known = F.create_map(*[F.lit(x) for kv in CATEGORY_OF_EVENT.items() for x in kv])
    rows = df.withColumns(
        {
            "_key": F.coalesce(text(session), F.lit("")),
            "_ev": name,
            "_cat": F.coalesce(F.upper(text("op_category")), F.try_element_at(known, name)),
            "_mark": F.when(name.isin(LOGIN), 1).when(name.isin(LOGOUT), 0),
            "_user": text(user),
            "_tok": text(token),
        }
    )
    order = [epoch, index]
    rows = scan(
        rows,
        ["_key"],
        order,
        {
            "_n": running_sum(F.lit(1)),
            "_before": last_seen("_mark"),
            "_seen": running_max(F.when(F.col("_mark") == 1, 1), inclusive=True),
            "_last": last_seen("_ev"),
            "_user_no": running_sum(F.when(F.col("_user").isNotNull(), 1).otherwise(0)),
            "_tok_no": running_sum(F.when(F.col("_tok").isNotNull(), 1).otherwise(0)),
        },
    )
    # the first user and token of the context bind it
    rows = rows.withColumns(
        {
            "_bu": F.when((F.col("_user_no") == 1), F.col("_user")),
            "_bt": F.when((F.col("_tok_no") == 1), F.col("_tok")),
        }
    )
    rows = scan(
        rows, ["_key"], order, {"_fu": last_seen("_bu", inclusive=True), "_ft": last_seen("_bt", inclusive=True)}
    )
    before = F.col("_before")
    login, logout = F.coalesce(F.col("_mark") == 1, F.lit(False)), F.coalesce(F.col("_mark") == 0, F.lit(False))
    inside = F.coalesce(before == 1, F.lit(False))
    ended = F.coalesce(before == 0, F.lit(False))
    now_in = F.when(login, True).when(logout, False).otherwise(inside)
    seen = F.coalesce(F.col("_seen") == 1, F.lit(False))
    auth_cat = F.coalesce(F.col("_cat").isin(AUTH_CATEGORIES), F.lit(False))
    needs = F.coalesce(F.col("_cat").isin(NEEDS_AUTH), F.lit(False))
    step = F.concat_ws("->", F.col("_last"), F.col("_ev"))
    sid = text(session)
    reasons = F.array(
        F.when(sid.isNull(), "missingSessionId").when(~sid.rlike(SESSION_FORM), "invalidSessionIdFormat"),
        F.when((F.col("_n") == 1) & ~login, "missingInitialLogin"),
        F.when(ended, "postLogoutOperation"),
        F.when(login & inside, "duplicateLogin"),
        F.when(logout & ~inside, "logoutWithoutLogin"),
        F.when(auth_cat & ~login & ~logout & ~now_in, "unauthenticatedOperation"),
        F.when(needs & ~now_in & seen, "unauthenticatedOperation").when(needs & ~now_in, "unauthenticatedBeforeLogin"),
        F.when(F.col("_user") != F.col("_fu"), "userIdMismatch"),
        F.when(F.col("_tok") != F.col("_ft"), "tokenMismatch"),
        F.when(
            F.col("_last").isNotNull() & F.col("_ev").isNotNull() & ~login
            & ~step.isin([f"{a}->{b}" for a, b in allowed]),
            "disallowedTransition",
        ),
    )
    out = rows.withColumns(
        {
            "violations": F.array_distinct(F.filter(reasons, lambda r: r.isNotNull())),
            "authenticated": now_in,
            "terminated": F.when(login, False).when(logout, True).otherwise(ended),
        }
    ).withColumn("violation_flag", F.size("violations") > 0)
    return out.drop(*[c for c in out.columns if c.startswith("_") and not c.startswith("_chunk")])
