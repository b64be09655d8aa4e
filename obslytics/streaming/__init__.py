"""obslytics.streaming"""
