"""Registered queries over the test tables, each with the SQL that gives the same result.

A module has `QUERIES` (name to function of session and folder) and `ORACLE`
(name to SQL). The tables hold no missing values, so queries that are about
missing or dirty cells derive them from the rows, the same way in both texts.
"""
