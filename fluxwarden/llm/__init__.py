"""Training-data operators over document, page and benchmark tables.

Nothing outside this package imports it; ``queries.py`` lists what the driver can run.
"""
