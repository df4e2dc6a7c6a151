"""One named query per operator and, where SQL can say the same, the SQL that checks it."""

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register
