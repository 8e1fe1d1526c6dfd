"""eventweir: event correlation as Spark jobs.

Reads logs and events into one event table, routes them to ordered rules, evaluates time conditions over recent
events and carries out the rules' actions as table transformations, in batch and with Structured Streaming.
"""
