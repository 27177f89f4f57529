"""Named queries over the given tables, with the SQL that must give the same rows."""

from turnlab.plans import stand_ins

QUERIES = {}
SQL = {}


def _with(ctes, body):
    body = body.strip()
    if body.upper().startswith("WITH "):
        rest = body[5:].strip()
        if rest.startswith("RECURSIVE "):
            return f"WITH RECURSIVE {ctes.strip()}, {rest[10:]}"
        return f"WITH {ctes.strip()}, {rest}"
    return f"WITH {ctes.strip()} {body}"


def _add(name, fn, sql, ctes=None):
    if name in QUERIES:
        raise ValueError(f"query {name} exists")
    QUERIES[name] = fn
    if sql:
        SQL[name] = _with(ctes, sql) if ctes else sql.strip()


def on_turns(name, sql=None):
    """Register a function of the turn table."""
    def wrap(fn):
        _add(name, lambda spark, sf_dir: fn(stand_ins.turns(spark, sf_dir)), sql, stand_ins.TURNS_SQL)
        return fn
    return wrap


def on_utterances(name, sql=None):
    """Register a function of the raw utterance table."""
    def wrap(fn):
        _add(name, lambda spark, sf_dir: fn(stand_ins.raw_utterances(spark, sf_dir)), sql,
             stand_ins.UTTERANCES_SQL)
        return fn
    return wrap


def on_texts(name, sql=None):
    """Register a function of the labelled texts."""
    def wrap(fn):
        _add(name, lambda spark, sf_dir: fn(stand_ins.labelled_texts(spark, sf_dir)), sql, stand_ins.TEXTS_SQL)
        return fn
    return wrap


def on_table(name, table, sql=None):
    """Register a function of one given table."""
    def wrap(fn):
        _add(name, lambda spark, sf_dir: fn(stand_ins.table(spark, sf_dir, table)), sql)
        return fn
    return wrap


def on_all(name, sql=None):
    """Register a function of (spark, sf_dir)."""
    def wrap(fn):
        _add(name, fn, sql)
        return fn
    return wrap
