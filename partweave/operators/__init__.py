"""Relational operators: matching, rules, reports, row rejection and schema drift."""
