"""Dataflow operators: matching engines, record shredding, row rejection, schema drift, skew handling."""
