"""huestrata.plans"""
