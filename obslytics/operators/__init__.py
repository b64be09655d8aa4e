"""obslytics.operators"""
