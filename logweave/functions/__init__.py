"""Column expressions.  Everything here returns a ``Column`` built from Spark built-ins, so it
stays inside whole-stage codegen and gets predicate pushdown where the predicate allows."""
