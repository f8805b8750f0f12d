"""sparkloom: a Spark-native engine for code and graph analytics.

Everything is a lazy DataFrame: sources turn files into model tables, operators
turn model tables into result tables, and actions happen only in sinks.
"""
