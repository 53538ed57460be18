"""huestrata.operators"""
